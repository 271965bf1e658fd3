"""Clustering analytics over weighted vectors, expressed as Spark DataFrame programs."""
