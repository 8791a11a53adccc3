"""Incident causality, code-graph and memory analytics as Spark DataFrame operators."""
