"""Training-data operators: dedup, scoring, filtering, mixing, encoding and extraction."""
