import os

import numpy as np
import pytest

from lodestrata.operators import vectorindex
from lodestrata.plans import retrieval as plans

SF = "/root/testdata/sf0.01"


def exact(rows, queries, k):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([i for i, _ in rows])
    q = np.array([v for _, v in queries], float)
    q /= np.linalg.norm(q, axis=1)[:, None]
    return {i: list(zip(ids[o := np.lexsort((ids, -np.round(s, 12)))[:k]].tolist(), s[o])) for (i, _), s in zip(queries, q @ x.T)}


def vectors(n=700, width=10):
    rng = np.random.default_rng(4)
    return [(i, [float(x) for x in rng.normal(size=width) + 3 * (i % 7)]) for i in range(n)]


def test_all_cells_and_enough_candidates_are_exact(spark, tmp_path):
    rows = vectors()
    odd = [(900, None), (901, [0.0] * 10), (902, [1.0]), (903, [float("nan")] * 10), (None, [1.0] * 10), (904, [None] * 10)]
    df = spark.createDataFrame(rows + rows[:5] + odd, "id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as code", "3 as unit", "4 as block")
    vectorindex.build(df, f"{tmp_path}/i", cells=9, parts=4)
    queries = spark.createDataFrame(rows[:40] + odd, "id long, embedding array<float>")
    got = {}
    for r in vectorindex.search(queries, f"{tmp_path}/i", 5, probes=9, refine=200, block_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    want = exact([(i, np.float32(v)) for i, v in rows], [(i, np.float32(v)) for i, v in rows[:40]], 5)
    assert got.keys() == want.keys()
    for key, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[key]] and np.allclose([s for _, s in found], [s for _, s in want[key]])


def test_few_probes_read_few_cells_and_added_rows_are_found(spark, tmp_path):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectorindex.build(df, f"{tmp_path}/i", cells=12)
    vectorindex.add(spark.createDataFrame([(5000, rows[3][1])], "id long, embedding array<double>"), f"{tmp_path}/i")
    one = df.where("id = 3")
    found = vectorindex.search(one, f"{tmp_path}/i", 2, probes=1)
    assert [r.id for r in found.orderBy("rank").collect()] == [3, 5000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and len(os.listdir(f"{tmp_path}/i/rows")) > 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_recall_of_the_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = list(zip(table.vec_id.tolist(), table.embedding))
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    got = {r.query_id: set(r.ids) for r in plans.ann_topk(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert np.mean([len(got[k] & {i for i, _ in w}) / 10 for k, w in want.items()]) >= 0.95


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    vectorindex.build(none, f"{tmp_path}/i")
    assert vectorindex.search(none, f"{tmp_path}/i", 3, 2).count() == 0
    vectorindex.add(spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>"), f"{tmp_path}/i")
    assert vectorindex.search(spark.createDataFrame([(9, [1.0, 2.0])], "id long, embedding array<double>"), f"{tmp_path}/i", 3, 2).first().id == 1


def test_cells_share_blocks_and_a_query_goes_once_to_each(spark, tmp_path):
    first, blocks = vectorindex._blocks([(0, 3), (2, 4), (3, 25), (4, 9), (5, 1)], 10, 7)
    assert first.tolist() == [0, -1, 0, 1, 4, 4, -1] and blocks.tolist() == [1, 1, 1, 3, 1, 1, 1]
    rows = vectors(300)
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectorindex.build(df, f"{tmp_path}/i", cells=12)
    found = [sorted(map(tuple, vectorindex.search(df.where("id < 20"), f"{tmp_path}/i", 3, 5, refine=60, block_rows=n).collect())) for n in (7, 100, 1000)]
    assert len(found[0]) == 60 and [r[:3] for r in found[0]] == [r[:3] for r in found[1]] == [r[:3] for r in found[2]]
