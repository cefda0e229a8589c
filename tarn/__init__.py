"""Tarn: a strict, Spark-native lake query engine."""
