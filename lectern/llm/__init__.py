"""Training-data operators: deduplication, decontamination, extraction, packing, scoring."""
