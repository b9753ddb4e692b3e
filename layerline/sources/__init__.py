"""Readers and writers: Parquet tables, landed JSON, Kafka, catalog tables and JDBC."""
