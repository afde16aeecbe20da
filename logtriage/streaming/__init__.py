"""Structured Streaming: the batch transformations on a stream, with a checkpointed alert sink."""
