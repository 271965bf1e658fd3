"""Relational building blocks: assignment, sums, sampling, range joins, evaluation."""
