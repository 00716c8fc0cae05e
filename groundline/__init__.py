"""Deterministic, evidence-grounded retrieval analytics as Spark plans."""
