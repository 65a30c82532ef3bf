"""Streaming of tamis."""
