"""Readers and writers of corpus and candidate formats."""
