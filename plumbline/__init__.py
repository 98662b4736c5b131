"""Evaluation analytics and corpus curation as lazy Spark plans."""
