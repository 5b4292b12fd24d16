"""Scalar functions, the operator registry and row hashing."""
