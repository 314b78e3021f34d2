"""Language identification by multilingual mixture inference.

Hashed byte n-grams of letters are counted per language over all labelled documents that
are not held out.  A document is a mixture: expectation-maximisation estimates the
share of each language from the n-gram likelihoods.  Then the languages join the set one
by one in the order of their shares, each set is fitted again, and this goes on, up to all
languages, while the penalised likelihood grows.  The shares of the set are returned,
and the leading language is predicted.

Edge cases: a null text, or one without letters, is ``und`` with score 0 and no languages, and
so is every text when nothing was learned; the shortest texts have n-grams too, as each counts
with a space at either end; rows whose language or text is null teach nothing; of languages with
equal likelihood the first in the alphabet leads; repeated rows are judged alike; a very long
text is counted whole; an empty table gives no rows; extra columns, whatever their names, are
carried (``accepted``) or ignored.  What is held is one row of ``BUCKETS`` numbers a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import pieces, utf8
from lodestrata.llm.folds import held_out

UNKNOWN = "und"
ORDER = 3
BUCKETS = 4096
ROUNDS = 12
SET_ROUNDS = 4
PENALTY = 6.0  # in units of log(n-grams) for each further language; n-grams overlap, so above 0.5
#: How much likelier by chance a text must be, as a logarithm, for none of the languages to be in it.  Of
#: 51,235 held-out documents in the learned languages the least likely one, a short text around a
#: secret, has 31.
EVIDENCE = 100.0
DOCS_AT_ONCE = 64
SLICE = 1 << 19


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def gram_counts(data: np.ndarray, at: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """A row of hashed n-gram counts for each text."""
    rows = len(at) - 1
    size = np.diff(at)
    b = np.full(int(size.sum()) + 2 * rows, 32, np.uint8)
    own = np.repeat(np.arange(rows), size)
    b[np.arange(len(own)) + 2 * own + 1] = _letters()[data[at[0] : at[-1]]]
    size = size + 2
    if len(b) < order:
        return np.zeros((rows, buckets), np.float32)
    m = len(b) - order + 1
    h = np.zeros(m, np.uint32)
    for i in range(order):
        h = h * np.uint32(0x01000193) ^ b[i : i + m]
    h = (h * np.uint32(2654435761)) >> np.uint32(16)
    doc = np.repeat(np.arange(rows), size)
    ok = (doc[:m] == doc[order - 1 :]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
    key = doc[:m][ok] * buckets + (h[ok] % np.uint32(buckets))
    return np.bincount(key, minlength=rows * buckets).reshape(rows, buckets).astype(np.float32)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def learn(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities, from all rows of (text, lang)."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, at = utf8(b.column(0))
            langs = np.array(b.column(1).to_pylist(), object)
            for lo, hi in pieces(at, SLICE):
                for i in range(lo, hi, DOCS_AT_ONCE):
                    j = min(hi, i + DOCS_AT_ONCE)
                    n = gram_counts(data, at[i : j + 1], order, buckets)
                    for lang in set(langs[i:j]):
                        total[lang] = total.get(lang, 0) + n[langs[i:j] == lang].sum(0, dtype=np.float64)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])

    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram int, n long")
    seen = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    langs = sorted(seen.lang.unique())
    n = np.full((len(langs), buckets), 0.5)
    for k, lang in enumerate(langs):
        own = seen[seen.lang == lang]
        n[k, own.gram.to_numpy()] += own.n.to_numpy()
    return langs, n / n.sum(1, keepdims=True)


def mixtures(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of counts: the shares of the languages of its set (0 outside), and the
    leading share times its posterior."""
    return fitted(c, p)[:2]


def fitted(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``mixtures`` gives, and how much likelier than chance the set makes the n-grams: the
    penalised log-likelihood less that of n-grams which are all alike."""
    rows, total, buckets = len(c), np.maximum(c.sum(1), 1), p.shape[1]
    used = np.flatnonzero(c.any(0))
    c, p = c[:, used], p[:, used].astype(np.float32)

    def fit(pi, own, rounds):
        for _ in range(rounds):
            pi = pi * ((c[own] / np.maximum(pi @ p, 1e-12)) @ p.T) / total[own, None]
        return pi

    langs, every = len(p), np.arange(rows)
    alone = c @ np.log(p).T
    shares = fit(np.full((rows, langs), 1 / langs, np.float32), every, ROUNDS)
    order = np.argsort(-shares, 1, kind="stable")
    best = np.argmax(alone, 1)
    value = alone[every, best].astype(np.float64)
    chosen = np.zeros((rows, langs), np.float32)
    chosen[every, best] = 1
    active = every
    for k in range(2, langs + 1):
        mask = np.zeros((len(active), langs), np.float32)
        np.put_along_axis(mask, order[active, :k], 1, 1)
        pi = mask * np.maximum(shares[active], 1e-3)
        pi = fit(pi / pi.sum(1, keepdims=True), active, SET_ROUNDS)
        v = (c[active] * np.log(np.maximum(pi @ p, 1e-12))).sum(1, dtype=np.float64) - PENALTY * (k - 1) * np.log(total[active] + 1)
        better = v > value[active]
        active, pi = active[better], pi[better]
        value[active], chosen[active] = v[better], pi
        if not len(active):
            break
    chosen /= chosen.sum(1, keepdims=True)
    rel = np.exp((alone - alone.max(1, keepdims=True)) / 2)
    top = np.argmax(chosen, 1)
    sure = np.where(chosen.max(1) == 1, rel[every, top] / rel.sum(1), 1.0)
    return chosen, chosen[every, top] * sure, value + total * np.log(buckets)


def judge(data: np.ndarray, at: np.ndarray, p: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the languages (none for a text without letters), score and evidence of each text."""
    rows, langs = len(at) - 1, len(p)
    shares, score, evidence = np.zeros((rows, langs), np.float32), np.zeros(rows), np.zeros(rows)
    for lo, hi in pieces(at, SLICE) if langs else ():
        for i in range(lo, hi, DOCS_AT_ONCE):
            j = min(hi, i + DOCS_AT_ONCE)
            shares[i:j], score[i:j], evidence[i:j] = fitted(gram_counts(data, at[i : j + 1], order, p.shape[1]), p)
            blank = ~lettered(data, at[i : j + 1])
            shares[i:j][blank], score[i:j][blank] = 0, 0
    return shares, np.clip(score, 0, 1), evidence


def lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    texts = (data[a:b] for a, b in zip(at, at[1:]))
    return np.array([bool(np.any((own | 32) - 97 < 26)) or has_letter(own.tobytes()) for own in texts], bool)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, extra: tuple = ()) -> DataFrame:
    """(doc_id, lang_pred, score, languages), with the columns of ``extra`` kept; languages are the
    set that was chosen and its shares, the largest first."""
    langs, probabilities = model
    held = docs.sparkSession.sparkContext.broadcast(probabilities)
    names = pa.array([*langs, UNKNOWN], pa.string())
    n = len(langs)

    def run(batches):
        for b in batches:
            shares, score, _ = judge(*utf8(b.column(1)), held.value, order)
            some = shares.any(1) if n else np.zeros(len(shares), bool)
            top = np.where(some, shares.argmax(1) if n else 0, n)
            rank = np.argsort(-shares, 1, kind="stable")
            sizes = (shares > 0).sum(1)
            flat = rank[np.arange(n) < sizes[:, None]]
            share = np.take_along_axis(shares, rank, 1)[np.arange(n) < sizes[:, None]]
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays([names.take(pa.array(flat)), pa.array(share.astype(np.float64))], ["lang", "share"]))
            rest = [b.column(k) for k in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(top)), pa.array(score), listed, *rest], names=["doc_id", "lang_pred", "score", "languages", *extra])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    kept = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in extra)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>{kept}")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", order: int = ORDER, least: float = 0.0, evidence: float = EVIDENCE) -> DataFrame:
    """The rows of ``docs`` whose text is in the learned languages, with a score of ``least`` at least;
    all columns stay.

    A text goes when it has no letter, or when chance explains its n-grams better than any set of
    languages, by ``evidence`` or more (as a logarithm, so a text of a few unknown words stays).  If
    nothing was learned, texts with a letter are accepted.
    """
    held = docs.sparkSession.sparkContext.broadcast(model[1] if model[0] else None)
    at_text = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            data, at = utf8(b.column(at_text))
            if held.value is None:
                yield b.filter(pa.array(lettered(data, at)))
            else:
                shares, score, gain = judge(data, at, held.value, order)
                yield b.filter(pa.array(shares.any(1) & (score >= least) & (gain > -evidence)))

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and judge every row."""
    model = learn(docs.where(~held_out("doc_id")))
    found = predict(docs.withColumn("held_out", held_out("doc_id")).select("doc_id", "text", "held_out"), model, extra=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")
