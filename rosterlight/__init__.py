"""Workforce and service-time analytics as Spark DataFrame operators."""
