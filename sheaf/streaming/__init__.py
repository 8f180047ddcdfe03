"""Structured Streaming: event logs, windows and per-origin state."""
