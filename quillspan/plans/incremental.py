"""Queries of problem 2: processing only new or changed records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators.ledger import WorkLedger, completed_versions, latest_scans, run_once
from quillspan.session import scratch
from quillspan.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """path of each file the next run takes up: the items that a run over a ledger in the shared folder leases and
    completes. What earlier runs completed under a valid token (a run that ended well) is done before."""
    ledger = WorkLedger(spark, scratch(spark, "ledger"))
    done = completed_versions(table(spark, d, "files"), table(spark, d, "index_runs"))
    return run_once(ledger, latest_scans(table(spark, d, "file_scans")), done, "next", datetime.now()).selectExpr("key as path")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": r"""
WITH sp AS (
  SELECT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path,
         nullif(lower(trim(hash)), '') AS hash, coalesce(is_deleted, false) AS gone, seen_at, scan_id
  FROM file_scans),
s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, scan_id DESC) AS rn
      FROM sp WHERE path IS NOT NULL AND seen_at IS NOT NULL AND (gone OR hash IS NOT NULL)),
fp AS (
  SELECT nullif(regexp_replace(regexp_replace(replace(trim(path), chr(92), '/'), '/{2,}', '/', 'g'), '^(\./)+', ''), '') AS path,
         nullif(lower(trim(hash)), '') AS hash, indexed_at
  FROM files),
f AS (SELECT fp.path, fp.hash, row_number() OVER (PARTITION BY fp.path ORDER BY indexed_at DESC, run_id DESC) AS rn
      FROM fp JOIN index_runs r ON fp.indexed_at BETWEEN r.started_at AND r.finished_at AND lower(trim(r.status)) = 'ok')
SELECT s.path FROM s LEFT JOIN f ON f.path = s.path AND f.rn = 1
WHERE s.rn = 1 AND NOT s.gone AND f.hash IS DISTINCT FROM s.hash
"""
}
