"""Training-data operators: filters, deduplication, mixing, search and scoring of text corpora."""
