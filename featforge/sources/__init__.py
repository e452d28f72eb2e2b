"""Readers, writers, the table registry and the versioned feature store."""
