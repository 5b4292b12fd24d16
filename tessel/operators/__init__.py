"""Relational operators: aggregates, groups, gathers, joins, partitioning."""
