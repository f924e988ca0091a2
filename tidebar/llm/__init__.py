"""Training-data operators: language, duplicates, secrets, contamination, toxicity, packing and token files."""
