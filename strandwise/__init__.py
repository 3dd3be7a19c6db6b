"""Strandwise: Spark-native similarity and data-preparation engine."""
