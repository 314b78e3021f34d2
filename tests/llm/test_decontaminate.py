import hashlib
import re

import numpy as np

from lodestrata.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    wins = set()
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            wins.add((i, tuple(w[s : s + width])))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(i)
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rng = np.random.default_rng(5)
    v = [f"Tok{i}" for i in range(12)] + ["É", "ß9", "the", "the", "the"]
    say = lambda n: " ".join(rng.choice(v, n))
    items = [(i, say(int(n))) for i, n in enumerate([13, 14, 40, 5, 1, 30])] + [(9, None), (10, " ,. "), (2, "second text under two"), (None, "no item id here"), (5, say(13))]
    docs = [(i, " ".join([say(int(rng.integers(0, 30))), items[int(rng.integers(0, 6))][1].lower(), say(int(rng.integers(0, 200)))])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "-- --"), (53, items[2][1]), (53, items[2][1]), (54, "no item id here"), (None, items[0][1]), (55, "é " * 3 + items[0][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as token", "2 as w", "3 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as win")
    got = [tuple(r) for r in decontaminate.contamination(d, i).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs, items)))


def test_shuffled_prefixes_give_the_same(spark, monkeypatch):
    docs, items = cases()
    long = " ".join(f"q{k % 997}" for k in range(20_000))
    docs += [(60, f"{long} {items[0][1]} {long}"), (61, long)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    got = [tuple(r) for r in decontaminate.contamination(d, i).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs, items)))


def test_empty_tables_and_filter(spark):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), i).count() == 0
    assert not decontaminate.contamination(d, i.limit(0)).where("contaminated").count()
    clean = sorted(str(x[0]) for x in brute(docs, items) if not x[5])
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(d, i).collect()) == clean
