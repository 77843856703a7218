"""Catalogue entries of the dangling-reference operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.operators.references import orphan_references, orphan_report
from lexweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(*(table(spark, sf_dir, t) for t in ("legal_child_parent_map_v1", "legal_parent_contract_v1", "parent_deletions", "legal_child_v2")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p1_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_KEY = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_FOUND = f"""
WITH refs AS (
  SELECT {_KEY.format('child_id')} AS child_id, {_KEY.format('external_parent_id')} AS external_parent_id, min(created_at) AS t
  FROM legal_child_parent_map_v1 WHERE external_parent_id IS NOT NULL GROUP BY 1, 2),
rows_of AS (
  SELECT {_KEY.format('external_parent_id')} AS k, min(created_at) AS first_at, max(created_at) AS last_at
  FROM legal_parent_contract_v1 WHERE external_parent_id IS NOT NULL GROUP BY 1),
gone AS (
  SELECT {_KEY.format('external_parent_id')} AS k, max(deleted_at) AS deleted_at
  FROM parent_deletions WHERE external_parent_id IS NOT NULL GROUP BY 1),
parent_kind AS (
  SELECT r.*, CASE
    WHEN g.k IS NOT NULL AND (p.k IS NULL OR p.last_at IS NULL OR g.deleted_at > p.last_at) THEN 'deleted'
    WHEN p.k IS NULL THEN 'missing'
    WHEN p.first_at > r.t THEN 'late' END AS kind
  FROM refs r LEFT JOIN rows_of p ON p.k = r.external_parent_id LEFT JOIN gone g ON g.k = r.external_parent_id),
found AS (
  SELECT 'external_parent_id' AS ref_field, child_id, external_parent_id, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period, kind
  FROM parent_kind WHERE kind IS NOT NULL
  UNION ALL
  SELECT 'child_id', child_id, external_parent_id, coalesce(strftime(t, '%Y-%m'), 'unknown'), 'missing' FROM refs
  WHERE child_id IS NOT NULL AND child_id NOT IN (SELECT {_KEY.format('child_id')} FROM legal_child_v2 WHERE child_id IS NOT NULL))
"""

SQL = {
    "p1_found": _FOUND + "SELECT * FROM found",
    "p1_report": _FOUND + "SELECT ref_field, period, kind, count(*) AS n_references, count(DISTINCT child_id) AS n_children, count(DISTINCT external_parent_id) AS n_parents FROM found GROUP BY ALL",
}
