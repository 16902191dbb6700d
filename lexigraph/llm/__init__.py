"""Training-data operators: search, filtering, deduplication, tokens and extraction."""
