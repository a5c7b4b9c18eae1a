"""Gleaner: Spark-native text reduction, evidence keeping and corpus preparation."""

__version__ = "0.1.0"
