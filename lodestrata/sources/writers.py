"""Sinks: append, overwrite, rejects, audit rows, serving tables, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT = "run_id string, table_name string, status string, rows_read long, rows_written long, rows_rejected long, error_detail string, finished_at timestamp"


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite(df: DataFrame, path: str, *cluster_by: str) -> None:
    """Full refresh.  ``cluster_by`` ranges and sorts the files, so that their statistics
    prune later scans."""
    out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    out.write.mode("overwrite").parquet(path)


def audit(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """A few rows of a run's own log; the schema is fixed as columns may be all null."""
    spark.createDataFrame(rows, AUDIT).write.mode("append").parquet(path)


def audited_append(df: DataFrame, valid: Column, path: str, audit_path: str, run_id: str, name: str, finished_at) -> dict[str, int]:
    """Appends the valid rows and one audit row whose counts the write itself has observed, so
    nothing is read twice.  A failed write leaves an audit row that says why, and raises.

    In Spark 4.1 a session that has observed a write can no longer apply trained models (their tasks
    hold the session, and its observations cannot be serialised): where both are needed, read
    ``df`` in a session of its own, ``spark.newSession()``.
    """
    seen, kept = Observation(), Observation()
    ok = F.coalesce(valid, F.lit(False))
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(~ok).alias("rows_rejected")).where(ok)
    try:
        append(rows.observe(kept, F.count(F.lit(1)).alias("rows_written")), path)
    except Exception as error:
        audit(df.sparkSession, [(run_id, name, "FAILED", None, None, None, str(error)[:1000], finished_at)], audit_path)
        raise
    counts = seen.get | kept.get
    audit(df.sparkSession, [(run_id, name, "SUCCESS", counts["rows_read"], counts["rows_written"], counts["rows_rejected"], None, finished_at)], audit_path)
    return counts


def serving(df: DataFrame, renames: dict[str, str], columns: list[str]) -> DataFrame:
    """Rows for a serving table: names normalised and mapped, known columns kept, NaN null."""
    plain = {c: renames.get(n := c.strip().lower().replace(" ", "_"), n) for c in df.columns}
    out = df.withColumnsRenamed(plain)
    kinds = dict(out.dtypes)
    kept = [c for c in columns if c in kinds]
    return out.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in kept))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, content_hash: str) -> DataFrame:
    """Rows by ``key`` with an ``action``: incoming ones are inserted, updated or skipped if
    the hash is equal; stored ones that are not incoming are kept."""
    old = stored.select(F.col(key).alias("_key"), F.col(content_hash).alias("_hash"))
    merged = incoming.join(old, F.col(key) == F.col("_key"), "left")
    action = F.when(F.col("_key").isNull(), "insert").when(F.col("_hash").eqNullSafe(F.col(content_hash)), "skip").otherwise("update")
    changed = merged.withColumn("action", action).drop("_key", "_hash")
    return changed.unionByName(stored.join(incoming.select(key), key, "left_anti").withColumn("action", F.lit("keep")))


def without(df: DataFrame, doomed: Column) -> DataFrame:
    """Rows for which ``doomed`` is not true; unknown stays."""
    return df.where(~F.coalesce(doomed, F.lit(False)))


def without_stale(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    return df.where(F.col(column) >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def add_missing(existing: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Create-or-get: the rows of ``existing``, and those of ``wanted`` with new names."""
    return existing.unionByName(wanted.dropDuplicates([name]).join(existing.select(name), name, "left_anti").select(*existing.columns))


def stale_counts(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """How many rows a cleanup removes and keeps, in one pass; without a date they go."""
    fresh = F.coalesce(F.col(column) >= F.lit(as_of) - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.agg(F.count_if(~fresh).alias("removed"), F.count_if(fresh).alias("kept"))


def rejects(df: DataFrame, path: str) -> None:
    """The rejected rows of a table go to a table of their own beside it."""
    df.write.mode("append").parquet(f"{path.rstrip('/')}_rejected")


def load_serving(df: DataFrame, renames: dict[str, str], columns: list[str], path: str) -> None:
    """Truncate and load: what the serving table held is replaced."""
    overwrite(serving(df, renames, columns), path)


def one_folder_each(df: DataFrame, key: str, text: str, path: str) -> None:
    """One text file per entity, in the folder ``key=value``.  Rows meet by entity first, so
    that each folder is written by one task."""
    df.select(key, text).repartition(key).write.mode("overwrite").partitionBy(key).text(path)
