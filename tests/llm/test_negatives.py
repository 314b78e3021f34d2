import math

import numpy as np
import pytest

from lodestrata.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, wanted=5):
    by_id = {}
    for key, vec, label in rows:
        if key is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vec])
        by_id[key] = min(by_id.get(key, own), own)
    out = []
    for a, (label, vec) in by_id.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vec, v)), k, lab) for k, (lab, v) in by_id.items() if k != a)
        for ps, p, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [(n, -ns) for ns, n, lab in scores if lab != label and 80 * -ps <= 100 * -ns <= 100 * -ps][:wanted]
            out += [(a, p, r + 1, n, -ps, ns) for r, (n, ns) in enumerate(fit)]
    return sorted(out)


def cases():
    rng = np.random.default_rng(7)
    low = [(int(k), [float(x) for x in rng.normal(size=3)], int(k) % 4) for k in range(0, 900, 3)]  # few dimensions: much is passed over
    mixed = [(k, [float(x) for x in rng.normal(size=rng.integers(0, 5))], int(rng.integers(0, 3))) for k in range(0, 1200, 4)]
    hot = [(k, [1.0, -0.5], k % 2) for k in range(150)] + [(500 + k, [float(k), 1.0], 1) for k in range(30)]  # a large group of equal vectors: ties
    odd = [(None, [1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf")], 2), (0, [1.0, 2.0], None)]
    odd += [(600, [1.0, 2.0], 1), (600, [1.0, 2.0], 1), (600, [0.5], 0), (601, [1.0, 2.0], 2), (602, [], 1), (603, [1.0, 1.0], 1), (604, [0.9, 1.7], 3)]
    return {"low": low, "mixed": mixed, "hot": hot, "odd": odd}


@pytest.mark.parametrize("name", sorted(cases()))
def test_matches_brute_force(spark, monkeypatch, name):
    rows = cases()[name]
    monkeypatch.setattr(negatives, "PAGE_ROWS", 8)
    monkeypatch.setattr(negatives, "SEARCHES_AT_ONCE", 7)
    monkeypatch.setattr(negatives, "ROUTED_AT_ONCE", 50)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as cell", "3 as score", "4 as vec", "5 as rank")
    got = [tuple(r) for r in negatives.hard_negatives(df, count=5, block_rows=40).collect()]
    assert sorted(got) == brute(rows)


def test_brackets_hold_and_pass_over_rows():
    rng = np.random.default_rng(1)
    x, a = np.floor(256 * rng.normal(size=(400, 4))), np.floor(256 * rng.normal(size=(20, 4)))
    most = float((x**2).sum(1).max())
    known = negatives.Cells(4, most, negatives._lifted(x, most)[:6])
    d, own = known.distances(a), negatives._distances(negatives._lifted(x, most), known.points)
    least, largest = known.bracket(a, d, own, own)
    exact = a @ x.T
    assert (least <= exact).all() and (exact <= largest).all()
    assert (largest < np.sort(exact, axis=1)[:, -5:-4]).mean() > 0.3


def test_without_rows_and_without_anchors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (3, None, 1)]
    assert negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, [], 1), (2, [], 1), (3, [], 2)], SCHEMA)).collect()[0].negative_score == 0
