import numpy as np

import corpus_pipeline
from lodestrata.llm import mergedrop
from lodestrata.llm.queries import TOKENIZERS
from tests.llm import test_decontaminate, test_repeats, test_simhash
from tests.llm.test_langid import corpus


def test_stages_match_brute_force(spark, tmp_path):
    rows, say = corpus(150)
    rng = np.random.default_rng(8)
    passage = say("aa", 70)
    bench = [(1, say("bb", 30)), (2, say("cc", 13))]
    docs = [(i, t, lang, "s", len(t)) for i, t, lang in rows]
    add = lambda t, lang="aa": docs.append((len(docs), t, lang, "s", 0))
    for i in range(6):
        add(say("aa", 40) + " " + passage + " " + say("aa", int(rng.integers(5, 40))))
        add(docs[i * 3][1])
    add(say("bb", 60) + " " + bench[0][1], "bb")
    add(bench[1][1], "cc")
    for t in (None, "", "12 34", "€€"):
        add(t)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t, *_ in docs if any(c.isalpha() for c in t or "")]
    comp = {d: c for d, _, c in test_simhash.brute(left)}
    left = [(d, t) for d, t in left if comp[d] == d]
    first, cut = {}, []
    for d, t in left:
        w = t.split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), d)
    for d, t in left:
        w = t.split()
        gone = {i for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < d for i in range(p, p + 50)}
        t = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if t:
            cut.append((d, t))
    bad = {r[0] for r in test_decontaminate.brute(cut, bench) if r[5]}
    want = {d: t for d, t in cut if d not in bad}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    v = mergedrop.Vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    assert {r.doc_id: mergedrop.decode(v, r.ids) for r in got} == want
    assert all(r.lossless for r in got) and bad and len(want) < len(left) - 1
    assert got[0].__fields__ == ["doc_id", "lang", "source", "n_chars", "ids", "lossless"]


def test_stage_columns_and_empty_input(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_stages_carry_any_columns_and_odd_rows(spark, tmp_path):
    names = ["_id", "_th", "_first", "spans", "row", "id", "th", "first", "shard", "bad_id", "languages", "lo", "body", "h", "label"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, "no id here"), (2, "other words " * 9), (3, None), (4, ""), (5, "w1 " * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(None, "a b"), (1, None), (2, "zz " * 13)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in got)
        kept = {r.doc_id for r in got}
        assert {None, 2} <= kept and (5 in kept or name == "substring dedup"), name
        assert sum(r.doc_id == 1 for r in got) == 2
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert ids.count() == len(rows) and ids.columns == [c for c in docs.columns if c != "text"] + ["ids", "lossless"]
