"""Spark-native data reduction: chunks, fingerprints, similarity, deltas, restore and their figures."""
