"""Composite jobs, derived inputs and the registered queries with their SQL twins."""
