"""Spark operators over the records of agent and operator work."""
