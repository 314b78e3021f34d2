import os

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import equipment, evaluation, maintenance_model
from lodestrata.sources import layout, writers
from lodestrata.streaming import micro


def overlaps(spark, path, column, values):
    """How many files a filter for each of the values must read."""
    ranges = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min(column), F.max(column)).collect()
    return sum(lo <= v <= hi for _, lo, hi in ranges for v in values)


def test_z_order_prunes_by_either_column(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "cast(pow(id * 7919 % 20011, 2) as long) as a", "date_add(date'2020-01-01', cast(id * 104729 % 5003 as int)) as b", "concat('k', id % 300) as c")
    df = df.unionByName(spark.createDataFrame([(1, None, None, None)], df.schema))
    layout.z_ordered(df, f"{tmp_path}/z", 16, "a", "b")
    writers.overwrite(df.coalesce(4), f"{tmp_path}/s")
    df.repartitionByRange(16, "a").sortWithinPartitions("a").write.parquet(f"{tmp_path}/one")
    values = {c: [r[0] for r in df.where("id % 997 = 5").select(c).collect()] for c in ("a", "b")}
    z, one = ({c: overlaps(spark, f"{tmp_path}/{p}", c, values[c]) for c in values} for p in ("z", "one"))
    assert sorted(spark.read.parquet(f"{tmp_path}/z").select("id", "a", "c").collect(), key=str) == sorted(df.select("id", "a", "c").collect(), key=str)
    each = len(values["a"])
    assert one["b"] > 14 * each and z["b"] <= 7 * each and z["a"] <= 7 * each and sum(z.values()) < sum(one.values())
    assert layout.with_z(df, "a", "b", "c", bits=4).agg(F.max("_z")).first()[0] < 1 << 12
    with pytest.raises(ValueError):
        layout.with_z(df, "a", "b", bits=40)


def test_small_files_are_packed(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "md5(cast(id as string)) as _file", "1 as _bin")
    df.repartition(40).write.parquet(f"{tmp_path}/s")
    sizes = [p.stat().st_size for p in (tmp_path / "s").glob("*.parquet")]
    layout.pack(spark, f"{tmp_path}/s", f"{tmp_path}/t", 4 * max(sizes))
    files = list((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 10 and sorted(spark.read.parquet(f"{tmp_path}/t").collect()) == sorted(df.collect())


@pytest.fixture
def observing(spark):
    """A session of its own, as observations stay in a session (see ``writers.audited_append``)."""
    return spark.newSession()


def test_upsert_rewrites_touched_buckets_alone(observing, tmp_path):
    spark = observing
    schema, root = "k long, h string, at int, bucket2 string", f"{tmp_path}/t"
    first = spark.range(200).selectExpr("id as k", "'a' as h", "1 as at", "'x' as bucket2")
    assert layout.upsert_buckets(first.union(spark.createDataFrame([(None, "a", 1, "x")], schema)), root, "k", "h", "at", buckets=16) == {"insert": 200, "update": 0, "skip": 0}
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    news = spark.createDataFrame([(5, "b", 2, "y"), (5, "c", 3, "z"), (900, "n", 2, "y"), (7, "a", 9, "same"), (5, "a", 0, "old")], schema)
    assert layout.upsert_buckets(news, root, "k", "h", "at", buckets=16) == {"insert": 1, "update": 1, "skip": 1}
    after = files()
    touched = {str(p.parent) for p in set(after) - set(before)}
    assert 1 <= len(touched) <= 3 and all(after[p] == before[p] for p in before if str(p.parent) not in touched)
    now = {r.k: (r.h, r.at) for r in spark.read.parquet(root).collect()}
    assert len(now) == 201 and now[5] == ("c", 3) and now[7] == ("a", 1) and now[900] == ("n", 2)
    assert layout.upsert_buckets(news, root, "k", "h", "at", buckets=16) == {"insert": 0, "update": 0, "skip": 3}  # a replay
    assert layout.upsert_buckets(spark.createDataFrame([(5, "older", 1, "q")], schema), root, "k", "h", "at", buckets=16)["skip"] == 1
    assert {r.k: (r.h, r.at) for r in spark.read.parquet(root).collect()} == now
    assert layout.upsert_buckets(first.limit(0), root, "k", "h", "at", buckets=16)["insert"] == 0


def test_upsert_stream_by_bucket(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, h string, at int").schema
    for n, rows in enumerate([[(1, "a", 1), (2, "a", 1)], [(2, "b", 2), (3, "a", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = micro.file_source(spark, f"{tmp_path}/in/*", schema)
        micro.upsert_sink(stream, layout.bucketed_upsert(f"{tmp_path}/t", "k", "h", "at", 4), f"{tmp_path}/cp").awaitTermination(120)
    assert {(r.k, r.h) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "a"), (2, "b"), (3, "a")}


def test_audit_counts_come_from_the_write(observing, tmp_path):
    import datetime

    spark = observing
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "if(id % 10 = 0, null, id) as v")
    sc, now = spark.sparkContext, datetime.datetime(2024, 1, 1)
    sc.setJobGroup("audited", "")
    counts = writers.audited_append(df, F.col("v") > 50, f"{tmp_path}/t", f"{tmp_path}/a", "r1", "t", now)
    sc.setLocalProperty("spark.jobGroup.id", None)
    want = {"rows_read": 1000, "rows_rejected": df.where("not coalesce(v > 50, false)").count(), "rows_written": spark.read.parquet(f"{tmp_path}/t").count()}
    assert counts == want
    row = spark.read.parquet(f"{tmp_path}/a").first()
    assert (row.status, row.rows_read, row.rows_written, row.rows_rejected) == ("SUCCESS", 1000, want["rows_written"], want["rows_rejected"])
    assert len(sc.statusTracker().getJobIdsForGroup("audited")) == 2  # the table's write and the audit row's
    with pytest.raises(Exception, match="(?i)divi"):
        writers.audited_append(df.withColumn("x", F.expr("id div (v - 7)")), F.col("x") >= 0, f"{tmp_path}/u", f"{tmp_path}/a", "r2", "u", now)
    assert spark.read.parquet(f"{tmp_path}/a").where("run_id = 'r2'").first().status == "FAILED"


def test_labels_join_on_bins(spark):
    events = spark.range(400).selectExpr("id % 3 as equipment_id", "date_add(date'1969-06-01', cast(id * 37 % 700 as int)) as event_date", "array('failure', 'critical', 'degradation_start', 'other')[id % 4] as event_type")
    events = events.unionByName(spark.createDataFrame([(1, None, "failure")], "equipment_id long, event_date date, event_type string"))
    weeks = spark.range(330).selectExpr("id % 3 as equipment_id", "date_add(date'1969-05-01', cast(7 * (id div 3) as int)) as week_end")
    got = equipment.labels(weeks, events, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "week_bin" in plan and "event_bin" in plan
    known, worst = [tuple(r) for r in events.collect()], {}
    for e, w in [tuple(r) for r in weeks.collect()]:
        worst[e, w] = max([equipment.SEVERITY.get(k, 0) for x, d, k in known if x == e and d is not None and 0 <= (d - w).days <= 30] or [0])
    assert {(r.equipment_id, r.week_end): r.severity for r in got.collect()} == worst


def test_places_equal_one_window(spark):
    from pyspark.sql.window import Window

    rows = spark.range(3000).selectExpr("id", "cast(if(id % 9 = 0, null, id % 3) as double) as label")
    w = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(42), "id"), "id")
    want = rows.select("id", (F.percent_rank().over(w) < 0.8).alias("is_train"), (F.row_number().over(w) % 5).cast("int").alias("fold"))
    split, fold = maintenance_model.stratified_split(rows, "label", ["id"]), maintenance_model.folds(rows, "label", ["id"])
    assert split.columns == ["id", "label", "is_train"]
    assert sorted(split.join(fold, "id").select("id", "is_train", "fold").collect()) == sorted(want.collect())


def test_distribution_equals_a_sorted_list(spark):
    rows = [("a", float(x * x % 101)) for x in range(500)] + [("b", 4.0)] + [("c", None), ("c", -1.0), ("c", 2.0)] + [("d", 1.0)] * 300
    got = {r.metric: r for r in evaluation.distribution(spark.createDataFrame(rows, "metric string, score double")).collect()}
    for m in "abcd":
        own = sorted(s for k, s in rows if k == m and s is not None)
        assert (got[m].p50, got[m].p95) == (own[len(own) // 2], own[min(int(len(own) * 0.95), len(own) - 1)])


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, a double")
    layout.z_ordered(none, f"{tmp_path}/z", 4, "id", "a")
    assert spark.read.parquet(f"{tmp_path}/z").count() == 0 and os.path.isdir(f"{tmp_path}/z")
    assert maintenance_model.folds(none, "a", ["id"]).count() == 0
