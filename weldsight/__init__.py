"""Spark-native fault-prediction analytics over machine-sensor streams."""
