"""Relational operators of record linkage: records, keys, retrieval, features, decisions, evaluation."""
