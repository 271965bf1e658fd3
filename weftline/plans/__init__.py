"""Clustering algorithms, their registries and the run of one configuration."""
