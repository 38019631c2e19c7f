"""Spark-native e-commerce analytics: web sessions, retail invoices, pricing and stock."""
