"""Operators for building training corpora: near-duplicates, scans, counts, classifiers, search and mixing."""
