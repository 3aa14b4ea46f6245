"""Training-data operators: packing, tokenisation, filtering, near-duplicates, fixity."""
