"""Spark-native retrieval, document-ETL and reconciliation operators."""
