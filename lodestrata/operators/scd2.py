"""Slowly changing dimensions, type 2, as pure functions of two frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(current: DataFrame, incoming: DataFrame, keys: list[str], content_hash: str = "row_hash") -> DataFrame:
    """``incoming`` with ``action`` INSERT, UPDATE or SKIP against the open versions.

    Keys must be unique in ``incoming``; resolve versions within a batch before.
    """
    open_ = current.where("_is_current").select(*keys, F.col(content_hash).alias("_old_hash"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "INSERT").when(F.col("_old_hash").eqNullSafe(F.col(content_hash)), "SKIP").otherwise("UPDATE")
    return incoming.join(open_, keys, "left").withColumn("action", action).drop("_old_hash", "_known")


def merge(current: DataFrame, incoming: DataFrame, keys: list[str], as_of, content_hash: str = "row_hash") -> DataFrame:
    """The new history: changed versions are closed at ``as_of`` and followed by open ones;
    keys that are not incoming stay open.  Merging the same batch again changes nothing."""
    at = F.lit(as_of).cast("timestamp")
    staged = classify(current, incoming, keys, content_hash).where("action <> 'SKIP'")
    changed = staged.where("action = 'UPDATE'").select(*keys, F.lit(True).alias("_changed"))
    closing = F.col("_is_current") & F.coalesce("_changed", F.lit(False))
    history = current.join(changed, keys, "left").withColumns(
        {"_effective_to": F.when(closing, at).otherwise(F.col("_effective_to")), "_is_current": F.col("_is_current") & ~closing}
    )
    fresh = staged.drop("action").withColumns({"_effective_from": at, "_effective_to": F.lit(None).cast("timestamp"), "_is_current": F.lit(True)})
    return history.drop("_changed").unionByName(fresh)


def initial(incoming: DataFrame, as_of) -> DataFrame:
    return incoming.withColumns({"_effective_from": F.lit(as_of).cast("timestamp"), "_effective_to": F.lit(None).cast("timestamp"), "_is_current": F.lit(True)})


def summary(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total"), F.count_if("_is_current").alias("current"), F.count_if(~F.col("_is_current")).alias("historical"))


def current(history: DataFrame) -> DataFrame:
    """The open versions."""
    return history.where("_is_current")
