"""Operators for training-data pipelines: extraction, filtering, deduplication,
decontamination, packing and vector search over large document tables."""
