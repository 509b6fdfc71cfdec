"""DataFrame operators: ownership, upward aggregation, cell joins."""
