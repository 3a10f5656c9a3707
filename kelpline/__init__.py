"""Kelpline: time-series features and classifier evaluation as Spark DataFrame operators."""
