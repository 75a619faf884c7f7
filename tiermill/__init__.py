"""Tiermill: a Spark-native medallion engine for multi-source sales analytics."""
