"""Column functions: cleaning, tags, token sets, vectors, text."""
