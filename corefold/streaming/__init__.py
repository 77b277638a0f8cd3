"""Linking records as they arrive."""
