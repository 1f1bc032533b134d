"""Readers and writers: captures, text corpora, vocabularies, result tables."""
