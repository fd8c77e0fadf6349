"""Composite jobs (E1-E5) and the catalog of registered queries."""
