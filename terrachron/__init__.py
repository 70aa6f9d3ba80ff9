"""Spark-native engine for versioned map data: histories, geometry, change feeds."""
