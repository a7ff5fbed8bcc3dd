"""Spark-native engine for pen trajectories: gestures, strokes, sessions, samples and ingest."""
