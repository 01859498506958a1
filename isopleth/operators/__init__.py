"""Operators, by family."""
