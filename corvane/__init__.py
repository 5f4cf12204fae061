"""corvane: a PySpark-native retrieval, case-search and evaluation engine."""
