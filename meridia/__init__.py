"""Spark-native evaluation, profiling and scoring of labelled text, vectors and detections."""
