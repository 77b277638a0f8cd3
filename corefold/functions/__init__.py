"""Scalar functions as Column expressions, and the Arrow UDFs for what Spark has no function for."""
