"""Training-data operators: scoring, joining, mixing, packing and media for document corpora."""
