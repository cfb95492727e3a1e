"""Operators for building training data. Nothing else in the library imports this subpackage."""
