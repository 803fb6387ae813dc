"""Training-data operators: tokenising, classifying, deduplicating, extracting and packing text."""
