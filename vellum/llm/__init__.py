"""Training-data operators: fingerprints, classifiers, deduplication, tokenising, packing."""
