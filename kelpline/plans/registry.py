"""Registered queries by name, with the SQL that checks each."""

from __future__ import annotations

from kelpline.plans import image_queries, series_queries, training_queries

QUERIES = series_queries.QUERIES | image_queries.QUERIES | training_queries.QUERIES
ORACLES = series_queries.ORACLES | image_queries.ORACLES | training_queries.ORACLES
