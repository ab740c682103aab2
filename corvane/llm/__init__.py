"""Training-data operators: deduplication, fingerprints, packing, formatting, scoring, archives."""
