"""Spark-native page-to-table analytics."""
