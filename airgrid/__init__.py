"""A Spark-native engine for broadcast-schedule data."""
