"""Readers of triples and corpora."""
