"""Spark-native curation of transcript and document corpora."""
