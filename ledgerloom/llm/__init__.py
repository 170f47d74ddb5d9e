"""Training-data operators: mixing, deduplication, packing, classification and extraction."""
