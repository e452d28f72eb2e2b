"""Composite jobs and their binding to concrete tables."""
