"""Scalar functions as SQL text that Spark and other engines read alike."""
