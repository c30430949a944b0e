"""Operators for training-data corpora: documents, pages, vectors and conversations."""
