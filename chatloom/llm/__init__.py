"""Operators of a training-data pipeline: deduplication, formatting, classification, mixing, packing, counting."""
