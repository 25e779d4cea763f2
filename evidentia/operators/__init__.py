"""Relational operators over evidence tables: deduplication, aggregation, entity resolution, temporal and region rules."""
