"""Harvest-productivity analytics as Spark table operators."""
