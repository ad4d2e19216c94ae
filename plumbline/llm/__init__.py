"""Training-data operators: deduplication, classifiers, extraction, token output."""
