"""Spark-native crop-yield and Earth-observation analytics."""
