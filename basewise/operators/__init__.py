"""Operators on tables of sequences, k-mers and counts."""
