"""Training-data operators: packing, search, archives, deduplication, scoring, privacy and tokenization."""
