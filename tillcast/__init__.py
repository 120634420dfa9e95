"""Merchant sales analytics as Spark DataFrame operators."""
