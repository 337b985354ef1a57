"""Operators for building training corpora: scans, dedup, search, packing and tokenisation."""
