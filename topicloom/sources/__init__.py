"""Readers and writers for corpora, word vectors and results."""
