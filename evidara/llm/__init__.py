"""Training-data operators: deduplication, classifiers, tokens, packing and chat formatting on Spark."""
