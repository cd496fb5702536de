"""All queries over the library's own operators, and their SQL."""

from __future__ import annotations

from . import assigned, augmented, conversions, detection, evaluation, lifecycle, phrases, points, ragged, records, tables, tracking, training

QUERIES = detection.QUERIES | tracking.QUERIES | tables.QUERIES | conversions.QUERIES | augmented.QUERIES | records.QUERIES | evaluation.QUERIES | training.QUERIES | points.QUERIES | lifecycle.QUERIES | phrases.QUERIES | ragged.QUERIES
ORACLE_SQL: dict[str, str] = detection.ORACLE_SQL | tracking.ORACLE_SQL | tables.ORACLE_SQL | conversions.ORACLE_SQL | augmented.ORACLE_SQL | records.ORACLE_SQL | evaluation.ORACLE_SQL | training.ORACLE_SQL | points.ORACLE_SQL | lifecycle.ORACLE_SQL | phrases.ORACLE_SQL | ragged.ORACLE_SQL | assigned.ORACLE_SQL
