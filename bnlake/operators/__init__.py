"""Table operators: preparation, splits, CPTs, factors, posteriors, metrics."""
