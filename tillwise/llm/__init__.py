"""Training-data operators: dedup, filtering, classification, mixing and token output."""
