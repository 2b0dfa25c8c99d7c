"""PySpark-native refinement and evaluation of synthetic tabular data."""
