"""Training-data operators: quality rules, chat formatting, language id, similarity joins, mixing, secret scans, deduplication, packing and fingerprints."""
