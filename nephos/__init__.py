"""Gridded-field and observation analytics, declared as Spark DataFrame plans."""
