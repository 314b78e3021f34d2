"""Operators on small frames: nulls, ties, empty input, and laws that must hold."""

import random
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import chunking, docparse, sap, synthetic, textsearch
from lodestrata.operators import bronze, equipment, evaluation, gold, maintenance_model, operations, quality, retrieval, scd2
from lodestrata.sources import readers, writers
from lodestrata.streaming import micro


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr).first()[0]


@pytest.mark.parametrize("text,want", [("20240131", date(2024, 1, 31)), ("00000000", None), ("", None), (None, None), ("20240231", None), ("x", None)])
def test_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sap.date8(F.col("t"))).first()[0] == want


def test_scalars(spark):
    assert one(spark, sap.unpadded(F.col("t")), t="0000") == "" and one(spark, sap.unpadded(F.col("t")), t="00120") == "120"
    d = spark.createDataFrame([(date(2024, 6, 30),), (date(2024, 7, 1),), (date(2021, 1, 3),)], "d date")
    assert [tuple(r) for r in d.select(sap.fiscal_year(F.col("d")), sap.fiscal_quarter(F.col("d")), sap.week_label(F.col("d"))).collect()] == [(2024, 4, "2024-W26"), (2025, 1, "2024-W27"), (2021, 3, "2020-W53")]


def test_required_split_and_drift(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    good, bad = bronze.required_split(df, ["k", "v"])
    assert good.count() == 1 and {r._rejection_reason for r in bad.collect()} == {"null k", "null v"}
    extra, missing, padded = bronze.drift(df, T.StructType([T.StructField(c, T.StringType()) for c in ("k", "z", "y")]))
    assert (extra, missing, padded.columns) == (["v"], ["y", "z"], ["k", "v", "y", "z"])


def test_hashes_and_nulls(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    loose = {r[0] for r in df.select(bronze.row_hash(df.columns)).collect()}
    strict = {r[0] for r in df.select(bronze.row_hash_strict(df.columns)).collect()}
    assert len(loose) == 1 and len(strict) == 2


def test_quality_and_gate(spark):
    df = spark.createDataFrame([(1, 5.0, date(2020, 1, 1)), (1, None, None), (2, -1.0, date(1990, 1, 1))], "k long, v double, d date")
    got = {(r.check_name, r.column_name): r for r in quality.run(df, [quality.not_null(df, "v"), quality.not_null(df, "gone"), quality.unique(df, ["k"]), quality.value_range(df, "v", 0, 10), quality.date_validity(df, "d")]).collect()}
    assert [got[k].failed for k in (("not_null", "v"), ("not_null", "gone"), ("unique", "k"), ("value_range", "v"), ("date_validity", "d"))] == [1, 3, 1, 1, 1]
    assert got[("date_validity", "d")].total == 2
    with pytest.raises(ValueError, match="not_null"):
        quality.gate(quality.run(df, [quality.not_null(df, "v")]))
    assert quality.run(df.limit(0), [quality.not_null(df, "v")]).first().passed
    assert quality.freshness(spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp"), "t", datetime(2024, 1, 1, 3), 4).first().passed
    assert not quality.row_count_change(df, 30).first().passed


VERSION = "k long, row_hash string"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 6), st.sampled_from("abc"), max_size=7), min_size=1, max_size=4))
def test_history_laws(spark, batches):
    rows = lambda b: spark.createDataFrame(sorted(b.items()), VERSION)
    history = scd2.initial(rows({}), "2024-01-01")
    for i, b in enumerate(batches):
        history = scd2.merge(history, rows(b), ["k"], f"2024-01-{i + 2:02d}")
        history = spark.createDataFrame(history.collect(), history.schema)
        again = scd2.merge(history, rows(b), ["k"], "2025-01-01")
        assert sorted(map(str, again.collect())) == sorted(map(str, history.collect()))
    found = history.orderBy("k", "_effective_from").collect()
    for k in {r.k for r in found}:
        own = [r for r in found if r.k == k]
        assert [r._is_current for r in own] == [False] * (len(own) - 1) + [True]
        assert all(a._effective_to == b._effective_from and a.row_hash != b.row_hash for a, b in zip(own, own[1:]))
        assert own[-1].row_hash == [b[k] for b in batches if k in b][-1]


def test_upsert_and_deletes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, h string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "id long, h string")
    assert {(r.id, r.action) for r in writers.upsert(old, new, "id", "h").collect()} == {(1, "keep"), (2, "skip"), (3, "update"), (4, "insert")}
    assert writers.without(old, F.col("h") == "a").count() == 2
    assert sorted(r.id for r in writers.add_missing(old, new.union(new), "id").collect()) == [1, 2, 3, 4]


def chunks(spark, rule, texts, **options):
    rows = rule(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), **options)
    return [r.chunks for r in rows.orderBy("i").collect()]


def test_chunks_hold_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab, .\n") for _ in range(rng.randrange(400))) for _ in range(150)]
    squeezed = lambda t: "".join(t.split())
    for text, got in zip(texts, chunks(spark, chunking.by_separator, texts, size=60, overlap=10, least=1)):
        assert all(squeezed(c) in squeezed(text) for c in got)
        assert set(squeezed(text)) <= set("".join(got))
    for got in chunks(spark, chunking.sliding, texts, size=60, overlap=10, least=5):
        assert all(c == c.strip() and len(c) >= 5 for c in got)


def test_chunk_examples(spark):
    parts = [c * 100 for c in "abcdefghij"]
    assert chunks(spark, chunking.by_separator, [None, "  ", "short"]) == [[], [], ["short"]]
    [got] = chunks(spark, chunking.by_separator, ["\n\n".join(parts)], size=310, overlap=120, least=50)
    assert got[0] == "\n\n".join(parts[:3]) and got[1].startswith(parts[2]) and got[-1].endswith(parts[-1])
    assert chunks(spark, chunking.by_separator, ["x" * 40 + "\n\n" + "y" * 500], size=300, overlap=0, least=50) == [["y" * 500]]
    assert chunks(spark, chunking.by_separator, ["z" * 700], size=300, overlap=100, least=50) == [["z" * 300, "z" * 300, "z" * 300]]
    assert chunks(spark, chunking.sliding, [None, "", "w" * 250], size=100, overlap=20, least=30) == [[], [], ["w" * 100, "w" * 100, "w" * 90]]


def test_semantic_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.0])], "id long, embedding array<double>")
    assert [r.id for r in retrieval.semantic(df, [2.0, 0.0], 5).collect()] == [1, 4]
    assert [r.id for r in retrieval.semantic_then_threshold(df, [2.0, 0.0], 1).collect()] == [1]
    docs = df.withColumn("content", F.lit("the pump is leaking"))
    assert retrieval.keyword(docs, "the of and", 3).count() == 0
    hits = retrieval.hybrid(docs, "leaking pumps", [2.0, 0.0], 3).collect()
    assert hits[0].id == 1 and hits[0].score == pytest.approx(0.7 / 61 + 0.3 / 61)
    with pytest.raises(ValueError):
        retrieval.json_contains("props", {"a') or 1": 1})


def test_equipment_edges(spark):
    r = spark.createDataFrame([(1, 1, "s", datetime(2024, 1, 1), 5.0, "GOOD"), (2, 1, "s", datetime(2024, 1, 1), 7.0, "BAD")], "event_id long, equipment_id long, sensor string, ts timestamp, value double, quality string")
    w = equipment.weekly(r.limit(1)).first()
    assert (w["std"], w.trend, w.week_end) == (0.0, 0.0, date(2024, 1, 7))
    assert equipment.latest_readings(r).first().value == 7.0
    states = spark.createDataFrame([(1, datetime(2024, 1, 1), "WARNING")], "equipment_id long, event_ts timestamp, state_to string")
    assert {x.state for x in equipment.state_as_of(r, states).collect()} == {"WARNING"}
    p = spark.createDataFrame([(1, 0.25, 0.25, 0.25, 0.25), (2, 1.0, 0.0, 0.0, 0.0)], "equipment_id long, p_low double, p_medium double, p_high double, p_critical double")
    got = {x.equipment_id: x for x in equipment.scored(p).collect()}
    assert (got[1].risk, got[1].health_score, got[1].remaining_days) == ("Low", 50, 18) and got[2].health_score == 100


def test_evaluation_places(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 2, 9)] + [("n", 3.0)], "metric string, score double")
    got = {r.metric: r for r in evaluation.distribution(df).collect()}
    assert (got["m"].p50, got["m"].p95, got["n"].p50, got["n"].p95, got["n"]["std"]) == (2.0, 9.0, 3.0, 3.0, 0.0)


@pytest.mark.parametrize("text,ok", [("select 1", True), ("WITH a AS (select 1) select * from a", True), ("", False), ("drop table x", False), ("select 1; DELETE from x", False), ("(DELETE from x)", False), ("select 'drop' as word", True), ("explain delete from x", False)])
def test_sql_guard(text, ok):
    assert (operations.check_sql(text) is None) == ok


def test_sql_result_and_markdown(spark):
    assert operations.safe_sql(spark, "select id from range(10)", 3).count() == 4
    with pytest.raises(ValueError):
        operations.safe_sql(spark, "set a = 1")
    text = operations.markdown(spark.createDataFrame([(1, None), (2, "a|b")], "a long, b string"), 1)
    assert text.splitlines()[0] == "| a | b |" and "(1 rows shown)" in text
    assert operations.sample_exact(spark.range(100), "id", 10, 1).collect() == operations.sample_exact(spark.range(100).repartition(7), "id", 10, 1).collect()


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    assert readers.landing_scan(spark, f"{root}/none") is None
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert readers.scan_or_empty(spark, f"{root}/none", schema).count() == 0
    writers.append(spark.range(3), f"{root}/t/2024/01/02")
    assert readers.landing_scan(spark, f"{root}/t", date(2024, 1, 2)).count() == 3
    writers.overwrite(spark.range(9), f"{root}/o", "id")
    assert readers.scan_or_empty(spark, f"{root}/o", schema).count() == 9
    writers.audit(spark, [("r", "t", "OK", 1, 1, 0, None, datetime(2024, 1, 1))], f"{root}/a")
    assert spark.read.parquet(f"{root}/a").first().error_detail is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "guide_pump.md").write_text("# Pump\nEQ-1000-A-001\nHealth Score: 40/100")
    (tmp_path / "d" / "rows.csv").write_text("a,b\n1,x\n")
    (tmp_path / "d" / "cat.json").write_text('{"products": [{"material": "M1", "name": "n"}]}')
    row = readers.documents_scan(spark, f"{root}/d", "md").select(docparse.title(F.col("text")), docparse.health_score(F.col("text")), docparse.document_type(F.col("source_file"))).first()
    assert tuple(row) == ("Pump", 40, "guide")
    assert readers.documents_scan(spark, f"{root}/d", "csv").first().text == "a: 1\nb: x"
    assert docparse.catalog_products(readers.documents_scan(spark, f"{root}/d", "json")).first().text == "material: M1\nname: n"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 5, i % 24), "ab"[i % 2], float(i)) for i in range(200)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = micro.file_source(spark, f"{tmp_path}/in", batch.schema)
    q = micro.append_sink(micro.tumbling(stream, "ts", "1 day", "event_type"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in micro.tumbling(batch, "ts", "1 day", "event_type").collect()}
    assert got == {r for r in want if r[0] < datetime(2024, 1, 5)}  # the last day is still open
    seen = []
    micro.upsert_sink(micro.deduplicated(stream, "ts", "event_id"), lambda b, _: seen.append(b.count()), f"{tmp_path}/cp2").awaitTermination(120)
    assert sum(seen) == 200


def test_model(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 2) * 3 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    split = maintenance_model.stratified_split(rows, "label", ["id"])
    assert split.where("is_train").count() == 320 and maintenance_model.folds(rows, "label", ["id"]).groupBy("fold").count().count() == 5
    model = maintenance_model.train(split.where("is_train"), ["x", "y"], "label", trees=5, depth=3)
    scored = maintenance_model.probabilities(model, split.where("not is_train"), 2)
    m = maintenance_model.metrics(maintenance_model.confusion(scored, "label")).first()
    assert m.accuracy == 1.0 and m.f1_macro == 1.0


def test_keyword_match_set_is_unlimited(spark, tmp_path):
    from lodestrata.plans import retrieval as plans

    spark.range(50).selectExpr("id as doc_id", f"if(id % 2 = 0, '{plans.ASKED}', 'other') as text").write.parquet(str(tmp_path / "documents.parquet"))
    found = plans.keyword_match_set(spark, str(tmp_path))
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in found.collect()} == set(range(0, 50, 2))


def test_folds_are_trained_and_scored(spark):
    rows = spark.range(120).selectExpr("id", "cast(id % 10 as double) as x", "cast(id % 3 as double) as y", "cast(id % 10 >= 5 as int) as label")
    mean, deviation = maintenance_model.cross_validated(rows, ["x", "y"], "label", ["id"], n=3, trees=5, depth=3)
    assert mean > 0.9 and 0 <= deviation < 0.2


def test_json_containment_is_typed(spark):
    rows = spark.createDataFrame([(1, '{"k": 42, "o": {"p": true}}'), (2, '{"k": "42"}'), (3, '{"k": 42.0}'), (4, '{"k": null}'), (5, "no json"), (6, None), (7, '{"o": "p"}')], "id int, props string")
    ids = lambda wanted: [r.id for r in rows.where(retrieval.json_contains("props", wanted)).orderBy("id").collect()]
    assert ids({"k": 42}) == [1, 3] and ids({"k": "42"}) == [2] and ids({"k": None}) == [4]
    assert ids({"o": {"p": True}}) == [1] and ids({"o": {}}) == [1] and ids({"o": {"p": 1}}) == []
    with pytest.raises(ValueError):
        retrieval.json_contains("props", {"k": [1]})


def test_metrics_of_cases_and_unknown_spans(spark):
    cases = spark.createDataFrame([(1, 0.5), (2, None)], "id int, s double")
    assert [(r.score, r.passed) for r in evaluation.evaluated(cases, "id", {"s": (F.col("s"), 0.4)}).orderBy("id").collect()] == [(0.5, True), (None, False)]
    with pytest.raises(ValueError):
        gold.prior_span("2000-01-01", "2000-01-31", "never")
    with pytest.raises(ValueError):
        gold.executive_summary(cases, "2000-01-01", "2000-01-31", ("weather",))


def test_state_as_of_equals_one_history(spark):
    rng = random.Random(3)
    stamp = lambda: datetime(2024, 1, rng.randint(1, 6), rng.randint(0, 23), rng.choice([0, 30]))
    marks = [(rng.choice([1, 1, 1, 2, None]), stamp(), rng.choice("ABC")) for _ in range(60)]
    reads = [(i, rng.choice([1, 1, 1, 2, 3]), stamp()) for i in range(120)]
    events = spark.createDataFrame(marks, "equipment_id long, event_ts timestamp, state_to string")
    readings = spark.createDataFrame(reads, "event_id long, equipment_id long, ts timestamp")
    got = {r.event_id: r.state for r in equipment.state_as_of(readings, events).collect()}
    want = {i: max(((t, s) for m, t, s in marks if m == e and t <= at), default=(None, "HEALTHY"))[1] for i, e, at in reads}
    assert got == want
    assert equipment.state_as_of(readings.limit(0), events).count() == 0
    assert {r.state for r in equipment.state_as_of(readings, events.limit(0)).collect()} == {"HEALTHY"}


def test_numbered_over_blocks(spark):
    keys = random.Random(1).sample(range(-500, 500), 200)
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    got = {r.k: r.r for r in operations.numbered(df, "k", 7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert operations.numbered(df.limit(0), "k").count() == 0


def test_trigrams(spark):
    near = lambda a, b: one(spark, textsearch.trigram_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert near("word", "words") == pytest.approx(4 / 7) and near("Two  words", "words two") == 1
    assert near("", "x") == 0 and near(None, None) == 0 and near("-", "-") == 0


def test_draws(spark):
    df = spark.range(20000).select(synthetic.uniform(1, "id").alias("u"), synthetic.normal(1, "id").alias("n"), synthetic.gamma(3, 1, "id").alias("g"), synthetic.seasonal(F.lit(1), 4, 2).alias("s"))
    r = df.agg(*(f(c).alias(f"{n}_{c}") for c in "ung" for n, f in (("avg", F.avg), ("var", F.variance))), F.max("s").alias("s"), F.min("u").alias("low"), F.max("u").alias("high")).first()
    assert 0 <= r.low and r.high < 1 and r.s == pytest.approx(2)
    assert [r.avg_u, r.avg_n, r.avg_g, r.var_n, r.var_g] == pytest.approx([0.5, 0, 3, 1, 3], abs=0.1)
    made = synthetic.sensor_readings(spark.range(300), "id", 1).groupBy("sensor").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).collect()
    assert len(made) == 6 and all(synthetic.SENSORS[x.sensor][0] <= x.lo < x.hi <= synthetic.SENSORS[x.sensor][1] and x.n == 300 for x in made)


def test_maps_and_fallback(spark):
    assert one(spark, sap.reverse_mapped(F.col("a"), {"x": 1, "y": 1, "z": 2}, "none"), a=1) == "x"
    assert one(spark, sap.reverse_mapped(F.col("a"), {"x": 1}, "none"), a=9) == "none"
    assert one(spark, sap.fallback(F.col("a").cast("string"), F.col("b")), a=None, b=" EUR ") == "EUR"


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "one"), ("b", "two\nlines")], "k string, t string")
    writers.one_folder_each(df, "k", "t", f"{tmp_path}/each")
    assert (sorted(p.name for p in (tmp_path / "each").glob("k=*"))) == ["k=a", "k=b"]
    assert spark.read.text(f"{tmp_path}/each/k=b", wholetext=True).first().value.strip() == "two\nlines"
    writers.rejects(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t_rejected").count() == 2
    for _ in range(2):
        writers.load_serving(df.withColumn(" Big Name", F.lit(float("nan"))), {"k": "key"}, ["key", "big_name"], f"{tmp_path}/s")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/s").orderBy("key").collect()] == [("a", None), ("b", None)]
    assert {tuple(r) for r in readers.head_samples({"x": df.where("k = 'a'"), "y": df.limit(0)}).collect()} == {("x", '{"k":"a","t":"one"}')}
    found = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 9)] + [(None,)], "ts timestamp")
    assert tuple(writers.stale_counts(found, "ts", datetime(2024, 1, 10), 5).first()) == (3, 1)


def test_upsert_stream_keeps_versions(spark, tmp_path):
    schema = T.StructType.fromDDL("k long, h string, at int")
    merge, sink = micro.versioned_upsert(f"{tmp_path}/t", "k", "h", "at"), f"{tmp_path}/cp"
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(1, "b", 3), (3, "d", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        micro.upsert_sink(micro.file_source(spark, f"{tmp_path}/in", schema), merge, sink).awaitTermination(120)
    versions = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert versions == ["000000000", "000000001"]
    rows = lambda v: sorted(tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/t/{v}").collect())
    assert rows(versions[0]) == [(1, "b"), (2, "c")] and rows(versions[1]) == [(1, "b"), (2, "c"), (3, "d")]
    merge(spark.createDataFrame([(1, "b", 3), (3, "d", 3)], schema), 1)  # a replay
    assert rows(versions[1]) == [(1, "b"), (2, "c"), (3, "d")]
