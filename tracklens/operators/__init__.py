"""Relational operators over audit tables: rules, aggregations, joins, verdicts."""
