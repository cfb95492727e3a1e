"""Emulsia: a PySpark-native engine for planning, tracking and auditing media archives."""

__version__ = "0.1.0"
