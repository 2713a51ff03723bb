"""Streaming forms of windows and runs."""
