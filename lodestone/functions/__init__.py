"""Column expressions and the few vectorised helpers they cannot replace."""
