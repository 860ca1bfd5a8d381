"""Structured Streaming forms of the batch windows. An extension: the batch operators are the model."""
