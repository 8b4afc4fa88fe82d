"""Column functions over nucleotide strings."""
