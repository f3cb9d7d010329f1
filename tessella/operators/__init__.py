"""Relational operators: coverage, sampling, rendering."""
