"""Spark-native analytics over case files, rule tables, answers and call logs."""
