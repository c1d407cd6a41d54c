"""Training-data operators: tokenising, packing, near-duplicates, quality."""
