"""Readers for corpora, queries and labelled lines; sinks for indexes and results."""
