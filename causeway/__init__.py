"""Spark-native analytics over observations, causal rules and a typed knowledge graph."""
