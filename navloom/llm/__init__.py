"""Training-data operators: extraction, scoring, deduplication, encoding, packing, archives, media."""
