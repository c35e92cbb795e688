"""Conversational-data analytics on Spark: DataFrame operators, sources, plans and streams."""

__version__ = "0.1.0"
