"""Structured Streaming twins of the event log and event-time windows."""
