"""Streaming of the scholarly library engine."""
