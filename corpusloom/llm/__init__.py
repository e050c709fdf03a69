"""Training-data operators: archives, near-duplicates, tokens, licences, quality, privacy, packing."""
