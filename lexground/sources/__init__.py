"""Readers and writers of the text formats, on Spark's own sources."""
