"""Operators for training-data corpora: one module per operator, none of them imported by the rest of the library."""
