"""Bronze: required fields, schema drift, lineage columns and row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required_split(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows lack a required field and say which is the first."""
    reason = F.coalesce(*(F.when(F.col(c).isNull(), f"null {c}") for c in required), F.lit(None).cast("string"))
    marked = df.withColumn("_rejection_reason", reason)
    return marked.where("_rejection_reason is null").drop("_rejection_reason"), marked.where("_rejection_reason is not null")


def drift(df: DataFrame, schema: T.StructType) -> tuple[list[str], list[str], DataFrame]:
    """Extra and missing column names, and the frame padded with null strings, in sorted
    order so that runs agree."""
    extra = sorted(set(df.columns) - set(schema.names))
    missing = sorted(set(schema.names) - set(df.columns))
    return extra, missing, df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def row_hash(columns: list[str], separator: str = "||") -> Column:
    """Compatible hash: nulls vanish, so (a, null, b) equals (a, b)."""
    return F.sha2(F.concat_ws(separator, *(F.col(c).cast("string") for c in columns)), 256)


def row_hash_strict(columns: list[str], separator: str = "||") -> Column:
    """As ``row_hash``, with nulls told apart from absent and from empty values."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns)), 256)


def named_hash(columns: list[str]) -> Column:
    """Hash of sorted ``name=value`` pairs joined by one pipe."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns))), 256)


def with_lineage(df: DataFrame, system: str, table: str, batch: str, run: str, load_type: str, at: Column, file: Column | None = None) -> DataFrame:
    """The eight lineage columns; ``at`` is passed in so that reruns are repeatable."""
    hashed = row_hash(df.columns)
    return df.withColumns(
        {
            "_bronze_ingestion_timestamp": at, "_bronze_batch_id": F.lit(batch), "_bronze_pipeline_run_id": F.lit(run), "_bronze_source_system": F.lit(system),
            "_bronze_source_table": F.lit(table), "_bronze_load_type": F.lit(load_type), "_bronze_file_path": file if file is not None else F.lit(None).cast("string"), "_bronze_row_hash": hashed,
        }
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()

