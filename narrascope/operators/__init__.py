"""Joins, aggregates, windows, ordering and set operators."""
