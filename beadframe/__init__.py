"""Spark-native analytics for two-colour bead-array methylation data."""
