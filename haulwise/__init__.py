"""Spark-native analytics for vehicle telemetry, weather and road networks."""
