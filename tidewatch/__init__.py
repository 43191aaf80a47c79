"""Spark-native analytics over dated document corpora: weak signals, their evidence and training-data operators."""
