"""Spark-native analytics for borings, strata and point graphs."""
