"""Perception and telemetry analytics as Spark DataFrame operators."""
