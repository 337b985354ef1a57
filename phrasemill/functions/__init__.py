"""Column functions: words, tags and measures."""
