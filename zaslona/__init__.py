"""Spark-native detection and masking of personal data in text, with corpus analytics."""
