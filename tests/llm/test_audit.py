import re
from itertools import permutations

from lodestrata.llm import audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def failed(i, rows):
    key, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
    out += "D" * bool(re.search(r"[#$%&*|]", text))
    out += "E" * any(key is not None and k is not None and k < key and (t or "") == text for k, t, _ in rows)
    return out


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = [failed(i, rows) for i in range(len(rows))]
    orders = ["".join(p) for p in permutations("ABCDE")]
    out, every = [], {}
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                here = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                late = sum(f in fails[i] for i in own) - len(here)
                alone = sum(fails[i] == f for i in own)
                out.append([part, order, step, len(left), len(here), late, alone, sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here)])
                every[part, f] = every.get((part, f), 0) + len(here)
    return sorted((*r, every[r[0], r[1][r[2] - 1]]) for r in out)


def cases():
    words = [f"w{i}" for i in range(150)]
    long = " ".join(words + words)
    rows = [
        (1, long, "en"), (2, long, "en"), (5, long, None), (3, long + " $", "en"), (4, " ".join(words * 4), "de"), (6, None, "en"), (7, "", "en"),
        (8, "ABC\x85def é\U0001f600 x y", ""), (9, long.upper(), "de"), (9, long.upper(), "de"), (None, long, "en"), (None, None, None), (None, None, None),
        (10, "a b a a a", "en"), (11, "a b a a a|", "de"), (12, "x" * 300_000 + " " + long, "de"), (13, " \t\n ", "en"), (9, "the same id, other text", "en"),
    ]
    return rows, [(1, 1, 0), (2, 0, 1), (9, 1, None), (9, 0, 1), (None, 1, 1), (6, None, 1), (77, 1, 1), (12, 1, 1)]


def test_every_order_matches_brute_force(spark):
    rows, labels = cases()
    clash = [f"{i} as {n}" for i, n in enumerate(["id", "h", "part", "digest", "word", "fails", "words", "first", "good", "n", "label_id"])]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *clash)
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", *clash)
    got = sorted(tuple(r) for r in audit.interactions(docs, marks).collect())
    assert got == brute(rows, labels)
    assert len(got) == 600 * 3


def test_aggregates_follow_one_shuffle(spark):
    df = audit.word_totals(spark.createDataFrame(cases()[0], DOCS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit.interactions(spark.createDataFrame([], DOCS), none).count() == 0
    got = audit.interactions(spark.createDataFrame([(1, "a", "x")], DOCS), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [tuple(r)[3:] for r in got] == [(0, 1, 0, 1, 0, 0, 120), *[(0, 0, 0, 0, 0, 0, 0)] * 4]
