"""millrace: a PySpark-native curation and evaluation analytics engine."""
