"""Structured Streaming forms of the folds: review interactions, announcements, fragments."""
