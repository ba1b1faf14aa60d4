"""Vulnerability and security-news analytics as PySpark DataFrame operators."""
