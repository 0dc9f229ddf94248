"""Narrative text analytics, declared as Spark DataFrame plans."""
