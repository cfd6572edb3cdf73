"""Training-data operators: filtering, deduplication, extraction, mixing and packing."""
