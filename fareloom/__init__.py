"""Airfare price statistics as Spark DataFrame operators."""
