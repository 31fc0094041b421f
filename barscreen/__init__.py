"""Screens, metrics and upkeep of daily price bars as PySpark DataFrame operators."""
