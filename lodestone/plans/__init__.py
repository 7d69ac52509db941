"""Whole plans: indexing, searching and evaluating."""
