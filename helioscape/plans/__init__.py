"""Registered queries: each pairs a Spark plan with an independent SQL text."""
