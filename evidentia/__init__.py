"""Evidentia: a Spark-native engine for comparable-transaction evidence."""
