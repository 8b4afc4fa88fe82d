"""Reading and writing banks of sequences and tables of counts."""
