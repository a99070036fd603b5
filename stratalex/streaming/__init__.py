"""Structured Streaming forms of the event-time aggregates; beyond what a batch engine needs."""
