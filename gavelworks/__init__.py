"""Timed-auction analytics as lazy Spark DataFrame operators."""
