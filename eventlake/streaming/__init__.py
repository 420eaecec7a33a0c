"""Tail, subscribe, consume, export and replicate on Structured Streaming."""
