"""Structured Streaming forms, beyond what the batch engine needs."""
