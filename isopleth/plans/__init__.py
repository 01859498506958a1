"""Plans that operators share: neighbourhood joins, weights, Gram aggregates."""
