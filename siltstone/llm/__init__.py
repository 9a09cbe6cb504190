"""Training-data operators: deduplication, mixing, search, scoring, tokenising and counting on Spark."""
