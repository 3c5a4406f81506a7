"""Operators for text corpora, similarity clusters and mergeable percentiles."""
