"""Pacelane: sports and human-performance analytics as Spark DataFrame jobs."""
