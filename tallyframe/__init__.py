"""Declarative multi-source table integration on Spark."""
