"""Batch and streaming jobs for news items at scale."""
