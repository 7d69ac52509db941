"""Where documents come from and where an index is kept."""
