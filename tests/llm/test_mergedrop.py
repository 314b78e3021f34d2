import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import mergedrop as m

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
V = m.Vocabulary(MODEL)
TEXTS = ["Hello world", " a  b\n", "a\tb", "　é😀\x00z", "", " ", "     x", "a\r\nb", "<s> </s> <0x41>", "internationalization of antidisestablishmentarianism", "Übergrößenträger señor", "x" * 300, "the " * 200]


def agenda(text, key, dropout):
    """The rule in its plainest form: look at all pairs, pop the best, start again."""
    merges = {int(k): (int(r), int(x)) for k, r, x in zip(V.key, V.rank, V.merged)}
    s, gone = [(int(V.char_id[ord(c)]), i, i + 1) for i, c in enumerate(text)], set()
    while True:
        best = None
        for i in range(len(s) - 1):
            (a, lo, mid), (b, _, hi) = s[i], s[i + 1]
            hit = merges.get(a << 32 | b) if a >= 0 and b >= 0 else None
            if hit and (lo, mid, hi) not in gone:
                best = min(best or (1 << 62,), (hit[0], i, hit[1], (lo, mid, hi)))
        if best is None:
            break
        _, i, x, borders = best
        if m._mix_one(m.candidate(*borders) ^ key) < m.bound(dropout):
            gone.add(borders)
        else:
            s[i : i + 2] = [(x, s[i][1], s[i + 1][2])]
    return [y for x, lo, _ in s for y in ([x] if x >= 0 else [V.byte_id[b] for b in text[lo].encode()])]


@pytest.mark.parametrize("text", TEXTS)
def test_without_dropout_equals_the_library(text):
    assert m.Encoder(V, 0.0, 1).encode([text], [0])[0].tolist() == SP.encode(text)


def test_literal_mark_survives():
    ids = m.Encoder(V, 0.0, 1).encode(["▁x ▁ y"], [0])[0].tolist()
    assert m.decode(V, ids) == "▁x ▁ y"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abetnrs ing▁é\n", min_size=1, max_size=80), st.floats(0, 1), st.integers(0, 2**64 - 1))
def test_the_heap_follows_the_agenda(text, dropout, key):
    assert m.encode_long(V, text, key, dropout) == agenda(text, key, dropout)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(0, 20))
def test_round_trip(text, variant):
    assert m.decode(V, m.Encoder(V, 0.3, 9).encode([text], [variant])[0].tolist()) == text


def test_spark(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (50, None), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.encoded(df, MODEL).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    again = m.encoded(df.repartition(3), MODEL).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    varied = m.encoded(spark.createDataFrame([(i, "internationalization " * 5) for i in range(30)], "doc_id long, text string"), MODEL).collect()
    assert len({tuple(r.ids) for r in varied}) > 5
    assert m.digests(df.limit(0), MODEL).count() == 0 and m.encoded(df.limit(0), MODEL).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a text", 5, "x", [1])], "doc_id long, text string, _text int, `row` string, `odd name` array<int>")
    plain = m.encoded(df.select("doc_id", "text"), MODEL).first()
    got = m.encoded(df.selectExpr("*", "7 as ids", "'y' as decoded", "2 as lossless", "'z' as document"), MODEL)
    assert got.columns == ["doc_id", "_text", "row", "odd name", "document", "ids", "decoded", "lossless"]
    assert tuple(got.first()) == (1, 5, "x", [1], "z", plain.ids, "a text", True)


def test_long_texts():
    texts = ["nospace" * 20_000, "many words " * 100_000]
    for t in texts:
        assert m.decode(V, m.Encoder(V, 0.1, 1).encode([t], [1])[0].tolist()) == t


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t * 3 for t in TEXTS]
    want = [x.tolist() for x in m.Encoder(V, 0.2, 1).encode(texts, list(range(len(texts))))]
    monkeypatch.setattr(m, "MOST_PATHS", 5)
    e = m.Encoder(V, 0.2, 1)
    assert [e.encode([t], [i])[0].tolist() for i, t in enumerate(texts)] == want


def test_each_occurrence_has_its_own_draws(spark):
    word = "internationalization"
    rows = [(i, f"{word} " * 20) for i in range(100)]
    got = m.encoded(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert len({tuple(r.ids) for r in got}) > 90  # by document
    split = m.Encoder(V, 0.1, 1).encode([f" {word}".join([""] * 200)], [5])[0]
    kinds = {tuple(w) for w in np.split(split, np.flatnonzero([V.bytes_of[i].startswith(b" ") for i in split.tolist()])) if len(w)}
    assert len(kinds) > 16  # within one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abetnrs ing▁é\n", max_size=60), min_size=1, max_size=5), st.floats(0, 1))
def test_what_is_remembered_equals_the_agenda(texts, dropout):
    e = m.Encoder(V, dropout, 5)
    for _ in range(2):
        for d, (t, ids) in enumerate(zip(texts, e.encode(texts, list(range(len(texts)))))):
            own = m._SEGMENT.findall(" " + t) if t else []
            keys = m.occurrence_keys(m.checksums(own), np.full(len(own), d, np.uint64), np.arange(len(own), dtype=np.uint64), 5).tolist()
            assert ids.tolist() == [i for s, k in zip(own, keys) for i in agenda(s, k, dropout)]


def test_agendas_move_32_bits_and_spell_odd_characters_where_they_stand():
    assert {x.dtype for x in (V.char_id, V.rank, V.merged)} == {np.dtype(np.int32)}
    words = ["a😀b", "the", "😀z\x00", "internationalization", " 　é"]
    none = np.zeros(len(words), np.int64)
    who, cand, ids, n = m.agendas(V, words, np.zeros((len(words), 0), np.int64), none)
    assert np.split(ids, np.cumsum(n)[:-1])[0].dtype == np.int32 and cand.dtype == np.int64
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [agenda(w, 0, 0.0) for w in words]
