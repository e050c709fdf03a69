"""Spark-native curation, checking and evaluation of labelled text corpora."""
