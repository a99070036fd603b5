"""PySpark-native analytics over text, morphology and evidence tables."""
