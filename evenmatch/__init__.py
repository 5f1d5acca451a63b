"""Matching texts to target descriptions and auditing the matches, as Spark jobs."""
