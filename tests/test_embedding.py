import pytest

from lodestrata.operators import embedding


class Flaky(embedding.HashingClient):
    """Fails on every other call, and always on one text; remembers the sizes of what it was asked."""

    def __init__(self, log):
        super().__init__(4)
        self.log, self.calls = log, 0

    def embed(self, texts):
        self.calls += 1
        with open(self.log, "a") as f:
            f.write(f"{len(texts)}\n")
        if "poison" in texts or self.calls % 2:
            raise OSError("service is away")
        return super().embed(texts)


def test_batches_retries_and_single_texts(spark, tmp_path):
    rows = [(i, f"text {i % 40}", i) for i in range(250)] + [(900, None, 0), (901, "  ", 0), (902, "poison", 0)]
    df = spark.createDataFrame(rows, "id long, content string, embedding_error int").coalesce(1)
    log = str(tmp_path / "log")
    got = {r.id: r for r in embedding.embedded(df, lambda: Flaky(log), batch=100, pause=0.0).collect()}
    assert len(got) == 253 and got[902].embedding is None and "service is away" in got[902].embedding_error
    assert all(got[i].embedding is None and got[i].embedding_error is None for i in (900, 901))
    want = embedding.HashingClient(4).embed(["text 7"])[0]
    assert got[7].embedding == got[47].embedding == pytest.approx(want) and got[7].embedding_error is None
    sizes = [int(x) for x in open(log)]
    assert max(sizes) == 41 and sizes.count(40) == 4 and sizes.count(41) == 3 and sizes.count(1) >= 41


def test_wrong_answers_and_empty_tables(spark):
    class Short(embedding.HashingClient):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    assert embedding.vectors(Short(4), ["a", "b"], 1, 0.0) == [(None, "ValueError: 0 vectors for 1 texts")] * 2
    none = spark.createDataFrame([], "content string")
    assert embedding.embedded(none, embedding.HashingClient).count() == 0
