"""Column expressions: scalars, aggregate measures, window measures."""
