import zlib

import numpy as np
import pytest

from lodestrata.llm import sharding

SCHEMA = "doc_id long, text string"


def network(x, half, seed):
    """The same network over plain integers."""
    left, right, mask, word = x >> half, x & ((1 << half) - 1), (1 << half) - 1, (1 << 64) - 1
    for key in sharding.round_keys(seed):
        m = (right ^ key) * sharding.MULTIPLIERS[0] & word
        m = (m ^ m >> 33) * sharding.MULTIPLIERS[1] & word
        left, right = right, left ^ ((m ^ m >> 33) & mask)
    return left << half | right


@pytest.mark.parametrize("rows", [1, 2, 3, 8, 64, 65, 1000, 4097])
def test_a_permutation_and_its_way_back(rows):
    got = sharding.permuted(np.arange(rows), rows)
    assert sorted(got) == list(range(rows))
    half = sharding.half_bits(rows)
    for i in range(0, rows, 1 + rows // 50):
        y = network(i, half, sharding.SEED)
        while y >= rows:
            y = network(y, half, sharding.SEED)
        assert y == got[i]
    assert (sharding.row_at(got % 8, got // 8, rows) == np.arange(rows)).all()
    if rows > 64:
        assert (got != sharding.permuted(np.arange(rows), rows, seed=5)).mean() > 0.9


def test_shuffles_well():
    got = sharding.permuted(np.arange(50_000), 50_000)
    assert abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.02
    assert np.abs(np.bincount(got[:10_000] * 20 // 50_000) - 500).max() < 110


def rows():
    out = [(int(i * 7919 % 1009), f"text {i} ü\U0001f600") for i in range(300)]
    return out + [(5, None), (None, None), (None, ""), (None, "x"), (4, "same"), (4, "same"), (4, "same"), (9, "y" * 500_000)]


def want(given, shards=8):
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    to = sharding.permuted(np.arange(len(order)), len(order))
    return sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", int(p % shards), int(p // shards), None, i) for i, ((k, t), p) in enumerate(zip(order, to))
    )


def test_places(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 2)
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as size", "2 as shard", "3 as row_number", "4 as copy", "5 as in_part")
    got = sorted((str(r[0]), *r[1:]) for r in sharding.places(df.repartition(3)).collect())
    assert got == want(rows())
    slots = {s: sorted(r[5] for r in got if r[4] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_whole_rows_and_their_files(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "doc_id + 1 as id", "'c' as crc", "'s' as shard", "1 as row_number", "`text` as `row`")
    out = sharding.sharded(df, shards=5)
    assert out.columns == ["doc_id", "text", "id", "crc", "row", "row_number", "shard", "slot"]
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.row)) for r in got) == sorted((str(k), str(t), str(t)) for k, t in rows())
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in got) == sorted((r[0], r[4], r[5]) for r in want(rows(), 5))
    sharding.written(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(rows()) and back.where("shard = 2").orderBy("slot").first().slot == 0


def test_empty_table(spark):
    assert sharding.places(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).count() == 0
