"""Readers of sequences, sample lists and other inputs."""
