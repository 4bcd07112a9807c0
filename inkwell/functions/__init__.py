"""Scalar functions, built as Column expressions wherever Spark can express them."""
