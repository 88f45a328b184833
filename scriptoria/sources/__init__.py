"""Sources of the scholarly library engine."""
