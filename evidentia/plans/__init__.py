"""Compositions of operators: audits, reports and the query catalogue."""
