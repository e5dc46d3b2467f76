"""PySpark-native analytics for evidence mining, dataset building and text corpora."""
