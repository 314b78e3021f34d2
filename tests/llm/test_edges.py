"""Very long texts, repeated rows, clashing columns and empty tables, where the operators' own tests have none."""

import hashlib

import xxhash

from lodestrata.llm import chat, oneperm, simhash, toxicity
from tests.llm.test_chat import TOKENIZER
from tests.llm.test_toxicity import corpus

LONG = " ".join(f"w{i * i % 9973}" for i in range(150_000))  # about a million characters


def test_simhash_of_a_long_text(spark, monkeypatch):
    assert len(LONG) > 800_000
    words = LONG.encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    rows = [(4, LONG), (2, LONG), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[4] == got[2] == (f"{want:016x}", 2) and got[9][1] == 9
    short = b"a b c d e f g h"
    whole = simhash.simhash(short, 3, 42)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 2)
    assert simhash.simhash(short, 3, 42) == whole


def test_keep_first_carries_clashing_columns(spark):
    names = ["row", "id", "first", "fp", "label", "component_id", "fingerprint", "_first"]
    rows = [(7, "a b c d", *range(8)), (3, "a b c d", *range(8)), (None, None, *range(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = simhash.keep_first(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.where("doc_id = 3 or doc_id is null").collect()))


def test_fingerprint_of_a_long_text(spark):
    rows = [(1, LONG), (2, LONG + " and an end"), (3, "short words only here now")]
    clash = [f"{i} as {n}" for i, n in enumerate(["q", "edited", "next_k", "for_k", "fingerprint", "part", "near_next", "n_chars"])]
    got = {r.doc_id: r for r in oneperm.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *clash)).collect()}
    assert got[1].n_chars == len(LONG) and got[1].near_next > 0.95 and got[2].near_next < 0.1
    q = len(LONG) // 4
    edited = LONG[: len(LONG) - q] + (LONG + " and an end")[:q]
    assert got[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_long_conversation(spark):
    long = LONG + r" \### assistant: </turn> " + LONG
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", ""), (2, 0, "assistant", long[:10])]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert got[2].loss_chars == 10


def test_toxicity_of_long_and_repeated_rows(spark):
    docs, labels = corpus(200)
    docs += [(700, LONG), (701, LONG), (701, LONG), (702, None)]
    clash = [f"{i} as {n}" for i, n in enumerate(["llr", "n", "peak", "chunk", "held_out", "score"])]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *clash), spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", *clash)).collect()
    assert len(got) == len(docs) and len({r.score for r in got if r.doc_id in (700, 701)}) == 1
