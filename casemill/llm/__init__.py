"""Training-data operators: packing, deduplication, classifiers, language models, search, mixing."""
