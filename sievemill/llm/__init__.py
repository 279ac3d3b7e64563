"""Training-data operators: decontamination, tokenising, deduplication, sharding, scoring, search and URL filters."""
