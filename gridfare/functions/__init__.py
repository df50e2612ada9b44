"""Shared column expressions and skew-safe primitives."""
