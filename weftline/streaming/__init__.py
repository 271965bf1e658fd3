"""Fitted models on unbounded inputs."""
