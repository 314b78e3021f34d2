import zlib
from collections import Counter, defaultdict
from math import exp, log

import numpy as np

from lodestrata.llm import toxicity


def brute_llr(rows, text, order=5, d=0.75):
    """Interpolated Kneser-Ney over bytes with dictionaries; one shared lower order."""
    c = {True: Counter(), False: Counter()}
    for t, toxic in rows:
        b = t.encode().lower()
        c[toxic].update(b[i : i + order] for i in range(len(b) - order + 1))
    every = set(c[True]) | set(c[False])
    cont, level = every, {}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in cont)
        cont = set(level[k])
    def shared(g):
        if not g:
            return 1 / 256
        own = level[len(g)]
        peers = [n for x, n in own.items() if x[:-1] == g[:-1]]
        return (own[g] - d + d * len(peers) * shared(g[1:])) / sum(peers)
    total, b = 0.0, text.encode().lower()
    for i in range(len(b) - order + 1):
        g = b[i : i + order]
        p = {}
        for k in c:
            peers = [n for x, n in c[k].items() if x[:-1] == g[:-1]]
            lam = d * len(peers) / sum(peers) if peers else 1.0
            ps = shared(g[1:]) if g in every else 1.0  # cancels when the n-gram is new to both
            p[k] = (max(c[k][g] - d, 0) / sum(peers) if peers else 0) + lam * ps
        total += log(p[True]) - log(p[False])
    return total


def corpus(n=600, seed=4):
    rng = np.random.default_rng(seed)
    v = ["".join(rng.choice(["th", "er", "ing", "ou", "an"], 3)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(v, rng.integers(20, 80)))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w[rng.integers(0, len(w))] = rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", "ish", "er"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_ratio_matches_brute_force(spark):
    docs, labels = corpus(30)
    rows = [(t, bool(x)) for (_, t), (_, x) in zip(docs, labels)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic boolean"))
    asked = [docs[0][1], "moronish idiots THING", "abc", "", "zzzzzzzz anything"]
    got = toxicity.score_rows(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i long, text string"), model, ["i"]).collect()
    for r in got:
        assert abs(r.llr - brute_llr(rows, asked[r.i])) < 1e-3
        assert r.n == max(0, len(asked[r.i]) - 4)


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (None, "idiot moron scum"), (3, docs[3][1])]
    labels += [(9999, 1), (None, 1), (7, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as toxic", "'x' as lang", "1 as gram")
    l = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'y' as text")
    got = toxicity.toxicity(d, l).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels[:600])
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 60 and np.mean([a == b for a, b in held]) > 0.9


def test_one_class_or_nothing(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(d, l.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(d, l.selectExpr("doc_id", "0 as toxic")).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), l).count() == 0


def test_a_model_larger_than_what_is_sent_scores_the_same(spark):
    docs, labels = corpus(30)
    rows = [(t, bool(x)) for (_, t), (_, x) in zip(docs, labels)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic boolean"), most=100)
    asked = [docs[0][1], "moronish idiots THING", "abc", "", "zzzzzzzz anything", None, docs[1][1]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i long, text string")
    got = toxicity.score_rows(df.repartition(2), model, ["i"]).collect()
    whole = {r.i: r for r in toxicity.score_rows(df, toxicity.learn(spark.createDataFrame(rows, "text string, toxic boolean")), ["i"]).collect()}
    assert sorted(r.i for r in got) == list(range(len(asked)))
    for r in got:
        assert abs(r.llr - brute_llr(rows, asked[r.i] or "")) < 1e-3
        assert r.n == whole[r.i].n and abs(r.peak - whole[r.i].peak) < 1e-6


def brute_scores(docs, labels, order=5):
    """All of ``toxicity`` with dictionaries and loops, but for the fit of the curve's five weights."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    marks = {}
    for d, x in labels:
        marks[d] = max(marks.get(d, 0), x)
    taught = [(d, t, marks[d] > 0) for d, t in docs if d in marks and fold(d) != 0]
    model = [(t, x) for d, t, x in taught if fold(d) != toxicity.CALIBRATION_FOLD]
    known: dict = {}

    def measures(text):
        b = text.lower()
        parts = [b[i : i + order] for i in range(len(b) - order + 1)]
        v = [known[g] if g in known else known.setdefault(g, brute_llr(model, g)) for g in parts]
        stretches = [sum(v[i : i + toxicity.WINDOW]) for i in range(len(v) - toxicity.WINDOW + 1)] or [sum(v)]
        n = max(len(v), 1)
        return [1, 100 * sum(v) / n, sum(v) / n**0.5, log(n), 10 * max(stretches) / toxicity.WINDOW]

    judged = [(measures(t), x) for d, t, x in taught if fold(d) == toxicity.CALIBRATION_FOLD]
    w = toxicity.calibrate(np.array([m for m, _ in judged]), np.array([float(x) for _, x in judged]))
    return {d: 1 / (1 + exp(-sum(a * b for a, b in zip(w, measures(t))))) for d, t in docs}


def test_score_and_peak_match_brute_force(spark):
    docs, labels = corpus(80, seed=9)
    docs = [(d, t[:150]) for d, t in docs]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = brute_scores(docs, labels)
    assert len(got) == len(want) and len(set(want.values())) > 60
    for r in got:
        assert abs(r.score / want[r.doc_id] - 1) < 1e-3
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_the_curve_is_where_its_gradient_is_zero():
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(200), rng.normal(size=(200, 3))]
    y = (x @ [0.3, 1.0, -2.0, 0.0] + rng.logistic(size=200) > 0).astype(float)
    w = toxicity.calibrate(x, y)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-2 * w).max() < 1e-6
