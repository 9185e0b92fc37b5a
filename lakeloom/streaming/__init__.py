"""Incremental processing of append-only inputs."""
