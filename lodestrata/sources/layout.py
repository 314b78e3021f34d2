"""How tables lie on disk: files clustered by several columns, packed files, upserts by bucket."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators import silver
from lodestrata.sources import scratch

BITS = 10  # of a column's rank: 1,024 ranges of about as many rows each
BUCKETS = 64


def _number(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: texts count by their first seven bytes."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return (F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c).cast("double")


def with_z(df: DataFrame, *columns: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``_z``: the bits of the columns' ranks, taken in turn, so that rows which are near
    in any of them are near in ``_z``.

    A rank is the place among the column's quantiles, so skewed values use all bits; nulls have
    the first.  The quantiles are ``2**bits`` numbers a column at most.
    """
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("the columns' ranks must fit into 62 bits")
    wide = df.withColumns({f"_n{k}": _number(df, c) for k, c in enumerate(columns)})
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = wide.agg(*(F.approx_percentile(f"_n{k}", shares, 100_000) for k in range(len(columns)))).first()
    z = F.lit(0).cast("long")
    for k in range(len(columns)):
        bounds = sorted({b for b in found[k] or [] if b == b and abs(b) != float("inf")})
        rank = F.when(F.col(f"_n{k}").isNull(), 0)
        if bounds:
            wide = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=f"_n{k}", outputCol=f"_r{k}", handleInvalid="keep").transform(wide)
            rank = rank.otherwise(F.col(f"_r{k}").cast("long"))
        for bit in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(F.coalesce(rank, F.lit(0)).cast("long"), bit).bitwiseAND(1), bit * len(columns) + k))
    return wide.withColumn("_z", z).select(*df.columns, "_z")


def z_ordered(df: DataFrame, path: str, files: int, *columns: str, bits: int = BITS) -> None:
    """Full refresh whose files are ranges of the interleaved ranks, so that a filter on any of the
    columns skips most of them by their statistics."""
    ranged = with_z(df, *columns, bits=bits).repartitionByRange(files, "_z", *columns).sortWithinPartitions("_z", *columns)
    ranged.drop("_z").write.mode("overwrite").parquet(path)


def pack(spark: SparkSession, source: str, target: str, size: int) -> None:
    """A copy of a Parquet table whose files hold the rows of about ``size`` bytes of its old files.

    Files are put into bins in the order of their paths; the bins come from the files'
    sizes, a row a file, and each is written by one task.
    """
    files = spark.read.parquet(source).select("_metadata.file_path", "_metadata.file_size").distinct()
    before = F.sum("file_size").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1))
    bins = files.select(F.col("file_path").alias("_path"), F.floor(F.coalesce(before, F.lit(0)) / size).alias("_bin"))
    path = scratch.folder(spark)
    bins.withColumn("_bin", F.dense_rank().over(Window.orderBy("_bin")) - 1).write.parquet(path)
    stored = spark.read.parquet(path)
    count = (stored.agg(F.max("_bin")).first()[0] or 0) + 1
    rows = spark.read.parquet(source)
    wrapped = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col("_metadata.file_path").alias("path"))
    binned = wrapped.join(stored, F.col("path") == F.col("_path"))
    binned.repartitionById(count, F.col("_bin")).select("row.*").write.mode("overwrite").parquet(target)


def upsert_buckets(incoming: DataFrame, root: str, key: str, content_hash: str, newest: str, buckets: int = BUCKETS, files: int = 1, counted: bool = True) -> dict[str, int] | None:
    """Inserts and updates rows by ``key`` in a table kept in folders by a hash of the key; only the
    folders that incoming keys fall into are written anew.  Returns the counts of actions, which
    the write itself observes, if they are ``counted`` (see ``writers.audited_append`` for what that takes).

    Of several incoming rows of a key the newest counts; one that is older than the stored row or
    has its hash is skipped, so a replay changes nothing.  Rows without a key are left out.
    """
    spark = incoming.sparkSession
    own = silver.latest(incoming.where(F.col(key).isNotNull()), [key], [F.desc(newest), F.desc(content_hash)])
    path = scratch.folder(spark)
    own.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.parquet(path)
    rows = spark.read.parquet(path)
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # one row a bucket at most
    counts = {"insert": 0, "update": 0, "skip": 0}
    if not touched:
        return counts
    try:
        stored = spark.read.schema(rows.schema).parquet(root).where(F.col("bucket").isin(touched))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = rows.limit(0)
    old = stored.select(F.col(key).alias("_key"), F.col(content_hash).alias("_hash"), F.col(newest).alias("_at"))
    stale = F.col("_hash").eqNullSafe(F.col(content_hash)) | F.coalesce(F.col("_at") > F.col(newest), F.lit(False))
    action = F.when(F.col("_key").isNull(), "insert").when(stale, "skip").otherwise("update")
    judged = rows.join(old, F.col(key) == F.col("_key"), "left").withColumn("_action", action)
    seen = Observation() if counted else None
    if seen is not None:
        judged = judged.observe(seen, *(F.count_if(F.col("_action") == a).alias(a) for a in counts))
    changed = judged.where("_action <> 'skip'").select(*rows.columns)
    kept = stored.join(rows.join(old, (F.col(key) == F.col("_key")) & ~stale).select(F.col(key).alias("_new")), F.col(key) == F.col("_new"), "left_anti")
    merged = changed.unionByName(kept).repartition(len(touched) * files, "bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(files)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    return seen.get if seen is not None else None


def bucketed_upsert(root: str, key: str, content_hash: str, newest: str, buckets: int = BUCKETS):
    """A ``merge`` for ``micro.upsert_sink`` that rewrites the touched buckets of each epoch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        upsert_buckets(batch, root, key, content_hash, newest, buckets, counted=False)

    return merge
