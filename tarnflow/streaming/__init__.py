"""Streaming sinks and event-time windows."""
