"""Whole plans: linkage from records to ID lists, and the catalogue of queries."""
