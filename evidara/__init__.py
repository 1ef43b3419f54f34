"""Evidara: evidence matching, identity resolution and reporting as Spark DataFrame plans."""
