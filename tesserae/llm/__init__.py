"""Training-data operators: de-duplication, tokenised output, packing, filtering, extraction."""
