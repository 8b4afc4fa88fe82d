"""Operators of a training-data pipeline: cleaning, deduplication, packing and output of text corpora.

Nothing outside this subpackage imports it.
"""
