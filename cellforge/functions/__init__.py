"""Column expressions: binning, addressing and predicates."""
