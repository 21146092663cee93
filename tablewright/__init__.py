"""Spark-native table quality, synthesis, evaluation and retrieval operators."""
