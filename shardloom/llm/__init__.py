"""Training-data operators: tokenising, de-duplication, filtering, formatting and packing."""
