"""Relational operators of the graph building pipeline."""
