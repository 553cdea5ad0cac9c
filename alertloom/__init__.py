"""Spark-native security-alert analytics: correlation, scoring, enrichment, temporal mining, streaming and evaluation."""
