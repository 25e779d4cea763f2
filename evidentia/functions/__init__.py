"""Column builders: text, urls, dates and identifiers."""
