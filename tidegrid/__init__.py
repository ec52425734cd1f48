"""Spark-native inventory, topology and flow analytics."""
