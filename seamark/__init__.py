"""Seamark: a Spark-first engine for building, ranking and evaluating web document collections."""
