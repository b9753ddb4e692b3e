"""Layered event analytics on PySpark: messages to bronze, silver and gold tables."""
