"""Palimpsest: a PySpark-native engine for collating, measuring and linking noisy text."""
