"""Spark-native similarity grouping, pipeline analytics and corpus preparation."""
