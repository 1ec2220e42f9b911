"""Longitudinal panel analytics as Spark DataFrame operators."""
