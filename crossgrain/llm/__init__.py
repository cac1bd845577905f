"""Training-data operators: filters, searches, deduplication, scoring, packing."""
