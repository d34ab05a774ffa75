"""Operators over matrices, vectors, ordered rows and measurements."""
