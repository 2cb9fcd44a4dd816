"""Operators on tables: ingest, tags, works, similarity, topics, ranking, serving, evaluation."""
