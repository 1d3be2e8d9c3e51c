"""Operators of a training-data pipeline: cleaning, deduplication, tokenisation and scoring of text corpora."""
