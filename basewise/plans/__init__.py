"""Whole runs over tables of documents: the registered queries and their SQL."""
