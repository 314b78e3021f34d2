"""Substring deduplication over words, with automata of repeated phrases.

Windows of 50 words that occur in several documents are found at anchors (see
``repeats``), which confirms the recurring passages: stretches of a text and the document
that has them first.  Texts are dealt out to shards; the passages that a shard's texts claim
are compiled into one Aho-Corasick automaton over word numbers, and all texts of
the shard stream through it, copies included.  An occurrence in a document after
the first with that phrase is removed; as the automaton compares the words themselves,
no hash removes anything.

Edge cases: a null text has no words; an empty table has no rows; a row without id is
neither removed from nor a source; rows that share an id are one place in the order, so
that they never remove from each other, and each gets its own result; repeated rows get
equal results; a very long text is streamed whole and makes its own shard large; extra
columns, whatever their names, are carried (``without_repeats``) or ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.repeats import Unit, claims, keyed, passages, removed, shard_of

WINDOW = 50
GRAM = 10
SHARD_BYTES = 1 << 20


def unit_of(window: int) -> Unit:
    return Unit(True, window, min(GRAM, window), False, SHARD_BYTES)


def occurrences(bodies: list[bytes], first: np.ndarray, texts: list[bytes], docs: np.ndarray):
    """Words of each text that lie in a phrase of an earlier document -> (text, start, words).

    A phrase is known by its words and the least document that has it."""
    number: dict[bytes, int] = {}
    phrases: dict[tuple, int] = {}
    for body, doc in zip(bodies, first.tolist()):
        key = tuple([number.setdefault(w, len(number) + 1) for w in body.split()])
        phrases[key] = min(doc, phrases.get(key, doc))
    none = (np.zeros(0, np.int64),) * 3
    if not phrases:
        return none
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, key in enumerate(phrases):
        machine.add_word(key, k)
    machine.make_automaton()
    size, least = np.array([len(x) for x in phrases]), np.array(list(phrases.values()))
    row, start, n = [], [], []
    for i, text in enumerate(texts):
        words = tuple([number.get(w, 0) for w in text.split()])  # no phrase holds a 0
        hits = np.array(list(machine.iter(words)), np.int64).reshape(-1, 2)
        hits = hits[least[hits[:, 1]] < docs[i]]
        row.append(np.full(len(hits), i))
        n.append(size[hits[:, 1]])
        start.append(hits[:, 0] + 1 - n[-1])
    return tuple(np.concatenate(x) for x in (row, start, n)) if row else none


def streamed(docs: DataFrame, id_col: str, text_col: str, window: int, schema: str, result) -> DataFrame:
    """All rows of ``docs``, each text with a mask of its words that are removed (None without any):
    ``result`` maps a table of (row: all columns of docs) and these to a table of ``schema``."""
    unit = unit_of(window)
    own = keyed(docs, id_col, text_col)
    claimed, shards = claims(own, unit)
    found = passages(own, claimed, unit)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))
    packed = packed.select("row", "doc_id", "text", F.coalesce(shard_of(shards), F.lit(0)).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t.encode() if t is not None else b"" for t in left.column("text").to_pylist()]
        ids = left.column("doc_id").combine_chunks()
        # a row without id has no later place than any other
        place = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        row, start, n = occurrences(right.column("body").to_pylist(), right.column("doc_id").to_numpy(), texts, place)
        masks: list = [None] * len(texts)
        for a, z in zip(*(np.searchsorted(row, np.unique(row), side) for side in ("left", "right"))):
            masks[row[a]] = removed(len(texts[row[a]].split()), start[a:z], n[a:z])
        return result(left.column("row").combine_chunks(), texts, masks)

    return packed.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, schema)


def kept_words(text: bytes, mask) -> list[bytes]:
    return text.split() if mask is None else [w for w, gone in zip(text.split(), mask.tolist()) if not gone]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: its words, the words removed, and a hash of what is kept."""

    def result(rows, texts, masks):
        kept = [kept_words(t, m) for t, m in zip(texts, masks)]
        gone = [int(m.sum()) if m is not None else 0 for m in masks]
        words = [len(k) + g for k, g in zip(kept, gone)]
        digest = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
        return pa.Table.from_arrays([rows.field(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return streamed(own, "doc_id", "text", window, "doc_id long, n_words long, n_removed long, kept_sha256 string", result)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts that have any; all other
    texts stay as they are, white space included.  A text of which nothing is left goes."""
    at, names = docs.columns.index(text_col), list(docs.columns)

    def result(rows, texts, masks):
        keep = np.ones(len(texts), bool)
        new = rows.field(at).to_pylist()
        for i, m in enumerate(masks):
            if m is not None:
                new[i] = b" ".join(kept_words(texts[i], m)).decode()
                keep[i] = bool(new[i])
        cols = [rows.field(k) if k != at else pa.array(new, pa.string()) for k in range(len(names))]
        return pa.Table.from_arrays(cols, names).filter(pa.array(keep))

    return streamed(docs, id_col, text_col, window, docs.schema, result)
