"""Sources: landing zones, documents, incremental reads, generated rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landing_scan(spark: SparkSession, root: str, day: date | None = None, schema: T.StructType | str | None = None, glob: str = "*.parquet") -> DataFrame | None:
    """Files of one day's folder (``root/Y/m/d``), or of ``root``; None if there is no path.

    Without ``schema`` the files' own is taken, so that drift can be seen afterwards.
    """
    path = f"{root}/{day:%Y/%m/%d}" if day else root
    reader = spark.read.option("pathGlobFilter", glob)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet scan, or an empty frame of ``schema`` where nothing was written yet."""
    found = landing_scan(spark, path, schema=schema)
    return found if found is not None else spark.createDataFrame([], schema)


def documents_scan(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(source_file, text) of whole files below ``root``: md, txt, json or csv rows."""
    if kind == "csv":
        rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
        pairs = [F.concat(F.lit(f"{c}: "), F.col(c)) for c in rows.columns]
        return rows.select(F.col("_metadata.file_path").alias("source_file"), F.concat_ws("\n", *pairs).alias("text"))
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{kind}")
    return whole.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def json_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def jdbc_scan(spark: SparkSession, url: str, relation: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relation read in ``parts`` ranges of a numeric key."""
    return spark.read.jdbc(url, relation, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def since_watermark(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows after the last watermark; all if there is none."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark))


def new_watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("watermark"))


def current_watermarks(log: DataFrame) -> DataFrame:
    """The latest value of each table in a log of (table_name, value, updated_at)."""
    return log.groupBy("table_name").agg(F.max_by("value", "updated_at").alias("value"))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("full_date"))


def series(spark: SparkSession, n: int, **axes: list[str]) -> DataFrame:
    """1..n for every combination of the given axes; the axes are literal lists."""
    out = spark.range(1, n + 1).select(F.col("id").alias("n"))
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def calendar_of(df: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last of a date or time column; none for an empty table."""
    ends = df.agg(F.min(F.col(column).cast("date")).alias("low"), F.max(F.col(column).cast("date")).alias("high")).where("low is not null")
    return ends.select(F.explode(F.sequence("low", "high", F.expr("interval 1 day"))).alias("full_date"))


def series_by(df: DataFrame, length: str, axis: DataFrame) -> DataFrame:
    """1..``length`` for every row of ``df`` with every row of ``axis``, whose few rows are the members
    of a dimension."""
    return df.where(F.col(length) > 0).crossJoin(axis).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(length).cast("long"))))


def catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, column_name, data_type, nullable) of a database's tables."""
    rows = [
        (t.name, c.name, c.dataType, c.nullable)
        for t in spark.catalog.listTables(database)
        for c in spark.catalog.listColumns(f"{database}.{t.name}")
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows); a count over Parquet reads the files' footers only."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()))


def with_row_counts(listing: DataFrame, counts: DataFrame) -> DataFrame:
    """Every listed table; without a count where there are no statistics."""
    return listing.join(counts, "table_name", "left")


def numeric_or_zero(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the session's catalog, as ``name`` or ``layer.name``."""
    return spark.table(name)


def head_samples(tables: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """(table_name, row): the first rows of each table as JSON, for a listing of the catalog."""
    cut = (df.limit(n).select(F.lit(name).alias("table_name"), F.to_json(F.struct("*")).alias("row")) for name, df in tables.items())
    return reduce(DataFrame.unionByName, cut)
