"""Operators of a training-data pipeline over text documents; nothing else in the library imports this package."""
