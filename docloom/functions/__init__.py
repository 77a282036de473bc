"""Column builders: text, identifiers, vectors, domain values and guards."""
