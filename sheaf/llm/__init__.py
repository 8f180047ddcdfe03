"""Training-data operators: deduplication, scoring, packing, fingerprints and token storage."""
