"""Queries over streams of sequences."""
