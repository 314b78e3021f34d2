import pytest

from lodestrata.operators import retrieval, searchfunctions, textindex

TEXTS = [(1, "a leaking pump"), (2, "pumps that leak oil, and leak again"), (3, "valve"), (4, "pump"), (5, None)]


def test_functions_equal_the_operators(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "id long, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.4]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, embedding array<double>")
    textindex.write(docs, f"{tmp_path}/i")
    names = [n for corpus in ("products", "documents") for n in searchfunctions.register(spark, corpus, vectors, f"{tmp_path}/i")]
    assert len(names) == 6
    rows = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert sorted(rows("select id, rank from documents_keyword('leaking pumps', 5)")) == sorted((r.id, r["rank"]) for r in textindex.search_stored(spark, f"{tmp_path}/i", "leaking pumps", 5).collect())
    assert rows("select id from products_keyword('leak', 1)") == [(2,)] and rows("select * from products_keyword('the of', 3)") == rows("select * from products_keyword(null, 3)") == []
    want = [(r.id, r.similarity) for r in retrieval.semantic(vectors, [1.0, 0.1], 2, 0.3).collect()]
    got = rows("select id, similarity from documents_semantic(array(1.0D, 0.1D), 2, 0.3D) order by similarity desc")
    assert [i for i, _ in got] == [i for i, _ in want] and got[0][1] == pytest.approx(want[0][1])
    hits = textindex.search_stored(spark, f"{tmp_path}/i", "leaking pumps", 9)
    fused = retrieval.hybrid(vectors, "leaking pumps", [1.0, 0.1], 3, least=0.3, hits=hits)
    assert [r[:3] for r in rows("select * from documents_hybrid('leaking pumps', array(1.0D, 0.1D), 3, 0.3D) order by score desc, id")] == [(r.id, r.rank_s, r.rank_k) for r in fused.collect()]
    assert rows("select count(*) from documents_keyword('pump', 9) k join products_semantic(array(1.0D, 0.0D), 9, 0.0D) s using (id)") == [(2,)]
    with pytest.raises(ValueError):
        searchfunctions.register(spark, "x; drop", vectors, f"{tmp_path}/i")
