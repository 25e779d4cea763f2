"""Readers, writers and parsers of outside formats."""
