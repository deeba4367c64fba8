"""Structured Streaming forms of detection, progress, stalls and sessions."""
