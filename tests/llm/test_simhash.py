import numpy as np
import xxhash

from lodestrata.llm import simhash


def brute(rows, bits=2):
    fps = {}
    for i, (d, t) in enumerate(rows):
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in fps if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(60):
        base = [vocab[i] for i in rng.integers(0, 40, rng.integers(1, 60))]
        for _ in range(rng.integers(1, 5)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.integers(0, len(copy))] = "X"
            rows.append((len(rows) * 3 + 7, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "null id"), (rows[4][0], rows[4][1]), (900, "ÄA É a"), (901, "Äa É A"), (902, "äa é a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as label", "2 as node")
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_every_pair_in_reach_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    masks = simhash.within(3)
    y = x ^ rng.choice(masks, 300)
    for a, b in zip(x, y):
        an, at, home = simhash.anchors(np.array([a, b]))
        assert set(an[(at == 0) & home]) & set(an[at == 1])


def test_large_anchor_agrees_with_small(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(12345) ^ rng.choice(simhash.within(3), 400))
    home = np.ones(len(fps), bool)
    one = simhash.links(fps, home, np.array([0]), np.array([len(fps)]), 2)
    monkeypatch.setattr(simhash, "LOOKUP_FROM", 10)
    two = simhash.links(fps, home, np.array([0]), np.array([len(fps)]), 2)
    for a, b in zip(simhash.star_labels(*one), simhash.star_labels(*two)):
        assert (a == b).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_keep_first(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (9, "other words entirely here now"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_first(df).collect()) == ["3", "9", "None"]
