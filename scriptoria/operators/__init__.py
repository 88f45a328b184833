"""Operators of the scholarly library engine."""
