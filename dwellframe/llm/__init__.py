"""Training-data operators: quality, duplicates, mixing, packing, tokens, links, privacy, search."""
