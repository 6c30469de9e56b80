"""Operators on DataFrames: projections, rules and gates, joins, aggregates, windows, dedup."""
