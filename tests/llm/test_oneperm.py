import hashlib

import numpy as np
import xxhash

from lodestrata.llm import oneperm
from lodestrata.llm.common import stored


def true_likeness(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus():
    rng = np.random.default_rng(6)
    v = [f"w{i}é" for i in range(500)]
    texts = [" ".join(rng.choice(v, int(n))) for n in rng.integers(0, 700, 40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [(1, None), (4, ""), (7, "one two"), (2, texts[0]), (500, texts[3]), (501, texts[3] + " a few more words")]


def test_contract(spark):
    rows = corpus()
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "1 as k", "2 as n", "'x' as head")
    got = {r.doc_id: r for r in oneperm.fingerprints(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows)
    errors = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - true_likeness(t, edited), r.near_next - true_likeness(t, nxt)]
    assert np.abs(errors).max() < 0.2 and np.abs(np.mean(errors)) < 0.02
    assert got[2].fingerprint == got[0].fingerprint and got[500].near_next > 0.7 and got[1].fingerprint == ""


def test_bins_match_brute_force(spark):
    rows = [r for r in corpus() if r[1]]
    out = oneperm.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "f").collect()
    table = oneperm.probes()
    assert all(sorted(p) == list(range(oneperm.BINS)) for p in table)
    for r in out:
        w = r.text.encode().split()
        if len(w) < 5:
            h = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
        else:
            h = []
            for i in range(len(w) - 4):
                seed = 42
                for x in w[i : i + 5]:
                    seed = xxhash.xxh64_intdigest(x, seed)
                h.append(seed)
        least = {}
        for x in (v >> 1 for v in h):
            least[x >> 56] = min(x, least.get(x >> 56, x))
        dense = [least[b] if b in least else next(least[t] for t in table[b] if t in least) for b in range(oneperm.BINS)]
        assert r.f == "".join(f"{x & 255:02x}" for x in dense)


def test_repeated_rows_null_ids_and_small_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other text"), (None, "no id"), (9, None)]
    got = oneperm.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "9", "None"]
    alone = oneperm.fingerprints(spark.createDataFrame([(3, "only one document here now")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert oneperm.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_shuffled_once(spark, monkeypatch):
    """The joins by key find the texts dealt out by it; a cast of the key would have them shuffled again."""
    plans = []
    monkeypatch.setattr(oneperm, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    oneperm.fingerprints(spark.createDataFrame(corpus(), "doc_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    made = plans[-1]
    assert "edited_sha256" in made and "SortMergeJoin" in made
    assert made.count("ENSURE_REQUIREMENTS") == 1 and "cast(k" not in made  # that of the places asked
