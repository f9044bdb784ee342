"""Relational operators: extraction, classification, joins, aggregates, sets, graphs."""
