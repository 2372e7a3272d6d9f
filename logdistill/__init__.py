"""Spark-native distillation, archiving and search of command and build output."""
