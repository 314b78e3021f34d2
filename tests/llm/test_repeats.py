import hashlib

import numpy as np
import pytest

from lodestrata.llm import phrases, repeats, runindex
from tests.llm.test_runindex import brute as brute_bytes


def brute_words(rows, window=50):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is None or t is None:
            continue
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(n=120, seed=3, vocab=30):
    rng = np.random.default_rng(seed)
    v = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(vocab)]
    passages = [list(rng.choice(v, int(k))) for k in rng.integers(50, 140, 8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(v, int(rng.integers(0, 150))))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 8)]
            a = int(rng.integers(0, 30))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = p[a : len(p) - int(rng.integers(0, 20))]
        if rng.random() < 0.3:
            w = w[:40] + w  # repeats itself
        rows.append((int(rng.integers(0, 10**6)) * 2, "\n ".join(w) if i % 7 else "  " + " ".join(w) + "\t"))
    for k in range(10):
        rows.append((k * 2 + 1, rows[k * 3][1]))
    return rows + [(7777777, None), (7777779, ""), (None, rows[0][1]), (rows[5][0], rows[9][1]), rows[2], rows[2], (88, "x " * 400), (90, "x " * 60)]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("seed,vocab", [(3, 30), (4, 2)])
def test_words_match_brute_force(spark, seed, vocab):
    rows = corpus(seed=seed, vocab=vocab)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as lo", "'x' as spans")
    got = [tuple(r) for r in phrases.deduplicated(df).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows), key=key)


def test_batches_of_texts_do_not_matter(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = [tuple(r) for r in phrases.deduplicated(df).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=key) == sorted(brute_words(rows), key=key)


@pytest.mark.parametrize("vocab", [30, 2])
def test_small_shards_and_slices_give_the_same(spark, monkeypatch, vocab):
    rows = corpus(vocab=vocab)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 100)
    monkeypatch.setattr(repeats, "SLICE", 500)
    monkeypatch.setattr(repeats, "HOT_FROM", 5)
    monkeypatch.setattr(repeats, "SHARD_TEXT", 3000)
    monkeypatch.setattr(repeats, "SHARDS_AT_ONCE", 2)
    got = [tuple(r) for r in phrases.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows), key=key)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.deduplicated(df).count() == 0
    assert phrases.without_repeats(df).count() == 0


def test_without_repeats_keeps_columns_and_clean_texts(spark):
    rows = [(1, "a", " ".join(f"w{i}" for i in range(80))), (2, "b", " ".join(f"w{i}" for i in range(80))), (3, "c", "pre  fix " + " ".join(f"w{i}" for i in range(60))), (4, None, None), (5, "e", " two  spaces ")]
    got = {r.doc_id: r for r in phrases.without_repeats(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[3].text == "pre fix" and got[5].text == " two  spaces " and got[1].text == rows[0][2] and got[4].text is None


def thue_morse(a, b, k):
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("kinds", [(0, 1, 0), (0, 1, 1), (1, 0, 0), (0, 0, 1)])
def test_words_that_a_sum_modulo_2_64_confuses(spark, kinds):
    pair = thue_morse("a", "b", 10)
    rows = [(i, " ".join(f"v{j}" for j in range(49)) + " " + pair[k]) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in phrases.deduplicated(df).collect()) == sorted(brute_words(rows))


def test_a_claim_that_the_words_deny_removes_nothing():
    a, b = (" ".join(f"{x}{i}" for i in range(60)).encode() for x in "ab")
    assert not len(phrases.occurrences([a], np.array([1]), [b], np.array([2]))[0])
    assert [x.tolist() for x in phrases.occurrences([a, a], np.array([4, 1]), [b + b" " + a, a], np.array([2, 1]))] == [[0], [60], [60]]


def test_clashing_columns_are_carried(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(80)), 7, "s", [1], {"a": 1}) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, spans string, shard array<int>, row map<string,int>")
    df = df.selectExpr("*", "9 as th", "named_struct('x', 1) as body", "8 as n", "'h' as h")
    got = phrases.without_repeats(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [tuple(df.first())]


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (2, "x " + long[100:]), (3, "y z")]
    got = {r.doc_id: r for r in phrases.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 149_900 and got[3].n_words == 2


@pytest.mark.parametrize("module", [phrases, runindex])
def test_a_line_with_other_text_around_it_makes_no_large_group(spark, monkeypatch, module):
    rng = np.random.default_rng(5)
    line = " ".join(f"b{i}" for i in range(30))
    other = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    rows = [(i, f"{other(60)} {line} {other(60)}") for i in range(150)]
    rows += [(1000 + i, f"{other(3)} {rows[i][1]}") for i in range(0, 40, 2)] + [(2000 + i, rows[i // 2][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((tuple(r) for r in module.deduplicated(df).collect()), key=key)
    assert sum(r[2] > 0 for r in want) >= 40
    unit = module.unit_of(module.WINDOW)

    def largest():
        own = repeats.keyed(df, "doc_id", "text")
        hot, _ = repeats.hot_grams(own, unit)
        return repeats.recurring(repeats.anchors(own, unit, hot)).where("several and rank = 1").groupBy("h").count().agg({"count": "max"}).first()[0]

    assert largest() > 100
    monkeypatch.setattr(repeats, "HOT_FROM", 20)
    assert largest() < 40
    assert sorted((tuple(r) for r in module.deduplicated(df).collect()), key=key) == want


def test_hot_grams_across_flushes_and_within_the_table(spark, monkeypatch):
    """A phrase that no flush holds often is found by its reports; a table that is full takes the more frequent."""
    unit = phrases.unit_of(50)
    line = " ".join(f"same{i}" for i in range(unit.gram))
    other = " ".join(f"next{i}" for i in range(unit.gram))
    rows = [(i, f"a{i} {line} b{i} " + (other if i % 8 == 0 else f"c{i}")) for i in range(2000)]
    own = repeats.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")

    def bits():
        return int(np.unpackbits(repeats.hot_grams(own, unit)[0]).sum())

    monkeypatch.setattr(repeats, "HOT_FROM", 100)
    assert bits() == 2
    monkeypatch.setattr(repeats, "HOT_TABLE", 8)  # room for one
    assert bits() == 1
    monkeypatch.undo()
    monkeypatch.setattr(repeats, "HOT_FROM", 100)
    monkeypatch.setattr(repeats, "HOT_HERE", 10**9)  # nothing is often in any flush
    monkeypatch.setattr(repeats, "HOT_SHARE", 2)
    monkeypatch.setattr(repeats, "HOT_FLUSH", 200)
    assert bits() >= 2


@pytest.mark.parametrize("asked", [0, 10**6])
def test_texts_not_asked_for_may_be_left_out(spark, monkeypatch, asked):
    monkeypatch.setattr(repeats, "ASKED_DOCS", asked)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    own = repeats.keyed(docs, "doc_id", "text")
    want = own.where("doc_id in (3, 7)").selectExpr("doc_id", "th", "1 as lo", "2 as n")
    got = {r.doc_id: bytes(r.body).decode() for r in repeats.cut(own, want, phrases.unit_of(50), []).collect()}
    assert got == {d: " ".join(f"w{d}_{k}" for k in range(1, 52)) for d in (3, 7)}


@pytest.mark.parametrize("module", [phrases, runindex])
def test_a_short_period_makes_no_row_for_each_turn(spark, module):
    """A line that texts repeat hundreds of times is one row of each, as are the claims that come of it."""
    rows = [(i, f"start{i} " + "Is onhe. " * 300 + f"end{i}") for i in range(12)] + [(20, "Is onhe. " * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    unit = module.unit_of(module.WINDOW)
    own = repeats.keyed(df, "doc_id", "text")
    assert repeats.anchors(own, unit, np.zeros(0, np.uint8)).count() < 10 * len(rows)
    assert repeats.claims(own, unit)[0].count() < 10 * len(rows)
    brute = brute_words if module is phrases else brute_bytes
    assert sorted(tuple(r) for r in module.deduplicated(df).collect()) == sorted(brute(rows))
