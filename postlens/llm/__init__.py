"""Training-data operators: deduplication, search, tokens, mixing, packing, quality, extraction."""
