"""Sparse, interpretable classification of sequences and score tables on Spark."""
