"""Operators bound to the driver tables, each with its SQL oracle."""
