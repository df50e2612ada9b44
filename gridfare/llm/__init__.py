"""Training-data operators: scoring, tokens, duplicates, search, packing, secrets, language, quality and shards."""
