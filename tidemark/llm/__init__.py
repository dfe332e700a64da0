"""Operators of a training-data pipeline: texts, tokens, shards and duplicates as Spark jobs."""
