"""Functions of the scholarly library engine."""
