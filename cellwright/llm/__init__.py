"""Training-data operators: tokenising, licences, deduplication, sharding, quality, scoring, packing."""
