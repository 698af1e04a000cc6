"""Relational operators over element rows: predicates and axes, projections, aggregates."""
