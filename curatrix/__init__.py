"""Catalogue analytics as Spark DataFrame operators."""
