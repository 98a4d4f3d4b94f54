"""Batch and streaming Spark jobs for a multi-restaurant ordering marketplace."""
