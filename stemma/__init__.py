"""Corpus search, cataloguing and maintenance as Spark jobs."""
