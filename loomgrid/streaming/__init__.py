"""Stateful operators, for batches and for Structured Streaming."""
