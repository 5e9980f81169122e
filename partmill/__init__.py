"""Marketplace analytics as Spark DataFrame programs."""
