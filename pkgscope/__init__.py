"""PySpark-native risk analytics over packages, text corpora and event tables."""
