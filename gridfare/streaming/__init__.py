"""Structured Streaming jobs and their batch definitions."""
