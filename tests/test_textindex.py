import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import english
from lodestrata.operators import retrieval, textindex

#: Examples of the published stemmer.
STEMS = """consign consign consigned consign consistency consist knightly knight generously generous generate generat happy happi dying die inning inning cried cri ties tie
gas gas this this kiwis kiwi hopping hop hoped hope luxuriated luxuri relational relat conditional condit rational ration vietnamization vietnam operator oper communication communic
cry cri by by say say agreed agre feed feed replacement replac adjustable adjust hopefulness hope formality formal electrical electr goodness good controlling control rolling roll
probate probat rate rate cease ceas analogies analog national nation bed bed sing sing bearings bear skies sky succeeding succeed knackeries knackeri a3s a3s"""


def test_stems():
    words = STEMS.split()
    assert [english.stem(w) for w in words[::2]] == words[1::2]


def brute(rows, query):
    """Scores by looking at all stretches."""
    asked = textindex.query_terms(query)
    out = {}
    for key, text in rows:
        found = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        stems = [(i, english.stem(w)) for i, w in enumerate(found) if w not in english.STOP_WORDS]
        hits = [(i, s) for i, s in stems if s in asked]
        if not asked or {s for _, s in hits} != set(asked):
            continue
        total, spans = 0.0, []
        for a in range(len(hits)):
            z = next((z for z in range(a, len(hits)) if {s for _, s in hits[a : z + 1]} == set(asked)), None)
            if z is not None:
                spans.append((a, z))
        for a, z in spans:
            if not any(a <= c and d <= z and (a, z) != (c, d) for c, d in spans):
                total += 0.1 / (1 + hits[z][0] - hits[a][0] - (z - a))
        out[key] = round(total, 9)
    return out


TEXTS = [
    (1, "the pump is leaking; pumps leak"), (2, "leaking"), (3, None), (4, ""), (5, "Pump! pump pump leak pump"), (6, "A leak, far away from the old pumps"),
    (7, "PUMPED leaks " * 50), (8, "pümpe leak Pump"), (9, "bearing of pump leaks pump bearing"), (10, "leak " + "x " * 5000 + "pump"),
]


@pytest.mark.parametrize("query", ["leaking pumps", "pump", "the of and", "bearing pump leak", "absent pump", "x"])
def test_search_matches_brute_force(spark, tmp_path, query):
    df = spark.createDataFrame(TEXTS, "id long, content string").selectExpr("*", "'c' as term", "1 as place", "2 as bucket", "3 as words")
    textindex.write(df, f"{tmp_path}/i", buckets=4)
    want = brute(TEXTS, query)
    assert {r.id: r["rank"] for r in textindex.search_stored(spark, f"{tmp_path}/i", query, None, buckets=4).collect()} == want
    top = [(r.id, r["rank"]) for r in textindex.search_stored(spark, f"{tmp_path}/i", query, 3, buckets=4).collect()]
    assert top == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert {r.id: r["rank"] for r in retrieval.keyword(df, query, None).collect()} == want


def test_only_own_lists_are_read(spark, tmp_path):
    path = f"{tmp_path}/i"
    textindex.write(spark.createDataFrame(TEXTS, "id long, content string"), path)
    textindex.write(spark.createDataFrame([(77, "a leaking pump"), (None, "pump leak")], "id long, content string"), path, mode="append")
    within = spark.createDataFrame([(77,), (1,)], "id long")
    found = textindex.search_stored(spark, path, "pump leak", None, within)
    assert {r.id for r in found.collect()} == {1, 77}
    lists = textindex.lists(spark, path, ["pump", "leak"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert {r[0] for r in lists.select(F.input_file_name()).distinct().collect()} < {str(p.absolute()) for p in tmp_path.rglob("*.parquet")} | {f"file://{p}" for p in tmp_path.rglob("*.parquet")}


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, content string")
    assert textindex.search(textindex.postings(none), "pump", 3).count() == 0
    assert retrieval.keyword(none, "pump", 3).count() == 0
    assert not math.isnan(sum(brute(TEXTS, "pump").values()))


def test_repeated_ids_and_long_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "WORDS_AT_ONCE", 3)
    texts = [(1, "pump leak pump"), (1, "the leak of a pump"), (2, "of the"), (3, None), (4, "leaking " * 9), (5, ""), (6, "pump")]
    batch = pa.RecordBatch.from_pylist([{"id": i, "words": (t or "").split()} for i, t in texts], pa.schema([("id", pa.int64()), ("words", pa.list_(pa.string()))]))
    found = [r for part in textindex._listed([batch.slice(0, 4), batch.slice(4)]) for r in part.to_pylist()]
    assert [(r["term"], r["id"], r["places"]) for r in found] == [
        ("pump", 1, [0, 2]), ("leak", 1, [1]), ("leak", 1, [1]), ("pump", 1, [4]), ("leak", 4, list(range(9))), ("pump", 6, [0]),
    ]
    df = spark.createDataFrame(texts, "id long, content string")
    assert sorted(map(tuple, textindex.dictionary(df).collect())) == [("leak", 2, 11), ("pump", 2, 4)]
    textindex.write(df, f"{tmp_path}/i")
    assert {r.id for r in textindex.search_stored(spark, f"{tmp_path}/i", "pump leak", None).collect()} == {1}


def test_texts_are_shuffled_once_and_stemmed_once(spark, tmp_path):
    """Lists are made where the text is: no row a place, and no second pass for the bounds of ranges."""
    seen = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame(TEXTS, "id long, content string").coalesce(2)
    count = lambda batches: (seen.add(b.num_rows) or b for b in batches)
    textindex.write(docs.mapInArrow(count, docs.schema), f"{tmp_path}/i")
    assert seen.value == len(TEXTS)
    plan = textindex.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
