"""Toxicity by two class-conditional Kneser-Ney models over bytes.

The n-grams of all labelled rows that are not held out are counted per class, as
exact keys in a distributed table.  Both classes discount their own n-gram counts
and back off to one shared distribution, built from the continuation counts of
both classes together, so a rare expression that neither class has seen much of
says nothing.  For an n-gram that neither class has seen, the shared part cancels
and only the two back-off weights of its context remain.  A document's score is a
calibrated function of its length-normalised log-likelihood ratios, over the whole text
and over its most telling stretch of ``WINDOW`` n-grams.

The ``MODEL_GRAMS`` most frequent n-grams and contexts are sent to the tasks.  If there
are more, no score changes: each chunk of texts asks for the n-grams it has beyond those, once
each, in a join with the whole stored tables.  ``CALIBRATION_ROWS`` bounds the labelled
rows that the final logistic curve is fitted on.

Edge cases: null and empty texts get the curve's value for a ratio of 0; without
labelled rows of both classes all scores are the share of toxic labels (0 if none);
several labels of a document count as their maximum; null labels teach nothing; repeated
rows get equal scores, and a labelled one teaches as often as it occurs; a very long text is
scored whole, as a chunk of its own; an empty table of documents gives no rows; extra columns of
either table, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import pieces, stored, utf8
from lodestrata.llm.folds import fold, held_out

ORDER = 5
WINDOW = 32
DISCOUNT = 0.75
MODEL_GRAMS = 2_000_000  # broadcast up to here, in 50 MB each for n-grams and contexts; the rest is joined
CALIBRATION_ROWS = 30_000
CALIBRATION_FOLD = 4
LABEL_ROWS = 1_000_000  # broadcast up to here; two numbers a row
SLICE = 1 << 20
FLUSH = 4_000_000


def grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of lower-cased bytes, and the row each belongs to."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    b = lower[data[at[0] : at[-1]]]
    m = len(b) - order + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(m, np.int64)
    for i in range(order):
        g = g << 8 | b[i : i + m]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = doc[:m] == doc[order - 1 :]
    return g[ok], doc[:m][ok]


def counts(rows: DataFrame, order: int) -> DataFrame:
    """(text, toxic) -> (gram, ct, co): counts of each n-gram in either class."""

    def run(batches):
        kept = []

        def merged():
            g = np.concatenate([x[0] for x in kept])
            own, back = np.unique(g, return_inverse=True)
            return own, *(np.bincount(back, np.concatenate([x[k] for x in kept]), len(own)).astype(np.int64) for k in (1, 2))

        for b in batches:
            data, at = utf8(b.column(0))
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(at, SLICE):
                g, doc = grams(data, at[lo : hi + 1], order)
                own, back = np.unique(g, return_inverse=True)
                t = toxic[lo:hi][doc]
                kept.append((own, np.bincount(back[t], minlength=len(own)), np.bincount(back[~t], minlength=len(own))))
            if sum(len(x[0]) for x in kept) > FLUSH:
                kept = [merged()]
                if len(kept[0][0]) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], ["gram", "ct", "co"])
                    kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["gram", "ct", "co"])

    found = rows.select("text", "toxic").mapInArrow(run, "gram long, ct long, co long")
    return found.groupBy("gram").agg(F.sum("ct").alias("ct"), F.sum("co").alias("co"))


def ratios(g: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios of seen n-grams (gram, n, llr), and back-off ratios of
    contexts (h, n, llr)."""
    d = F.lit(DISCOUNT)
    shared = None  # lower orders, shortest first: P(w | shorter context) from continuation counts
    level, cont = {}, g.select("gram")
    for k in range(order - 1, 0, -1):
        cont = cont.select((F.col("gram").bitwiseAND((1 << 8 * k) - 1)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        level[k], cont = cont, cont.select("gram")
    for k in range(1, order):
        own = level[k].withColumn("h", F.shiftright("gram", 8))
        total = own.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        own = own.join(total, "h")
        if shared is None:
            back = own.withColumn("p", F.lit(1 / 256))
        else:
            back = own.withColumn("low", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(shared.withColumnsRenamed({"gram": "low", "ps": "p"}), "low")
        shared = back.select("gram", ((F.col("n") - d + d * F.col("types") * F.col("p")) / F.col("total")).alias("ps"))
    context = g.groupBy(F.shiftright("gram", 8).alias("h")).agg(
        F.sum("ct").alias("nt"), F.sum("co").alias("no"), F.count_if(F.col("ct") > 0).alias("tt"), F.count_if(F.col("co") > 0).alias("to")
    )

    def weight(types, n):
        return F.when(F.col(n) > 0, d * F.col(types) / F.col(n)).otherwise(1.0)

    def p(own, types, n):
        seen = F.greatest(F.col(own) - d, F.lit(0.0)) / F.col(n) + weight(types, n) * F.col("ps")
        return F.when(F.col(n) > 0, seen).otherwise(F.col("ps"))

    full = (
        g.withColumns({"h": F.shiftright("gram", 8), "low": F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1)})
        .join(context, "h")
        .join(shared.withColumnRenamed("gram", "low"), "low")
        .select("gram", (F.col("ct") + F.col("co")).alias("n"), (F.log(p("ct", "tt", "nt")) - F.log(p("co", "to", "no"))).alias("llr"))
    )
    return full, context.select("h", (F.col("nt") + F.col("no")).alias("n"), (F.log(weight("tt", "nt")) - F.log(weight("to", "no"))).alias("llr"))


def least_sent(df: DataFrame, most: int) -> int:
    """The least count for which at most ``most`` rows have it or a higher one."""
    by_n = df.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(1_000_000).collect()
    left, least = most, 1
    for r in by_n:
        left -= r.rows
        if left < 0:
            least = r.n + 1
            break
    return least


class Lookup:
    """A hash table in two arrays, key -> value, with linear probing and a load of a
    half at most."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(key), 1)))) + 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.float32)
        left, step = np.arange(len(key)), 0
        while len(left):
            at = self._at(key[left], step)
            free = self.key[at] == -1
            self.key[at[free]] = key[left[free]]
            here = self.key[at] == key[left]
            self.value[at[here]] = value[left[here]]
            left, step = left[~here], step + 1

    def _at(self, key, step):
        home = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (home.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if missing), and the places of the missing keys."""
        out, missing = np.zeros(len(key), np.float32), []
        left, step = np.arange(len(key)), 0
        while len(left):
            at = self._at(key[left], step)
            there = self.key[at]
            hit, free = there == key[left], there == -1
            out[left[hit]] = self.value[at[hit]]
            missing.append(left[free])
            left, step = left[~(hit | free)], step + 1
        return out, np.concatenate(missing) if missing else left


class Model:
    """The most frequent n-gram and context ratios as lookups, and all of them as tables
    if that is not the whole model (None if it is)."""

    def __init__(self, seen: Lookup, context: Lookup, tables: tuple[DataFrame, DataFrame] | None):
        self.seen, self.context, self.tables = seen, context, tables


def learn(rows: DataFrame, order: int = ORDER, most: int = MODEL_GRAMS) -> Model:
    """(text, toxic) -> n-gram and context ratios."""
    g = stored(counts(rows, order))
    tables, lookups, whole = [], [], True
    for df in ratios(g, order):
        df = stored(df)
        least = least_sent(df, most)
        whole = whole and least == 1
        t = df.where(F.col("n") >= least).toArrow()
        tables.append(df)
        lookups.append(Lookup(t.column(0).to_numpy(), t.column(2).to_numpy()))
    return Model(*lookups, None if whole else tuple(tables))


def measured(g: np.ndarray, doc: np.ndarray, v: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, number and peak of the n-grams' ratios ``v`` for each of ``rows`` texts."""
    total, n, peak = np.bincount(doc, v, rows), np.bincount(doc, minlength=rows), np.full(rows, -np.inf)
    if len(v) >= WINDOW:
        c = np.r_[0.0, np.cumsum(v, dtype=np.float64)]
        inside = np.flatnonzero(doc[: len(v) - WINDOW + 1] == doc[WINDOW - 1 :])
        np.maximum.at(peak, doc[inside], c[inside + WINDOW] - c[inside])
    return total, n, np.where(np.isfinite(peak), peak, total) / WINDOW


def answers(docs: DataFrame, seen, tables: tuple[DataFrame, DataFrame], order: int) -> DataFrame:
    """(chunk, gram, llr): the ratio of each n-gram that is in a chunk and not in ``seen``.
    A chunk asks once, so an n-gram that all texts have comes once a chunk."""

    def ask(batches):
        lookup = Lookup.__new__(Lookup)
        vars(lookup).update(seen.value[0])
        for b in batches:
            data, at = utf8(b.column(0))
            chunk = b.column(1).to_numpy()
            for lo, hi in pieces(at, SLICE):
                g, doc = grams(data, at[lo : hi + 1], order)
                missing = lookup.get(g)[1]
                owner = chunk[lo:hi][doc[missing]]
                for c in np.unique(owner):
                    own = np.unique(g[missing[owner == c]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c)), pa.array(own)], ["chunk", "gram"])

    asked = docs.select("text", "chunk").mapInArrow(ask, "chunk long, gram long").withColumn("h", F.shiftright("gram", 8))
    full, context = tables[0].select("gram", F.col("llr").alias("own")), tables[1].select("h", F.col("llr").alias("back"))
    found = asked.join(full, "gram", "left").join(context, "h", "left")
    return found.select("chunk", "gram", F.coalesce("own", "back").cast("float").alias("llr")).where("llr <> 0")


def score_rows(docs: DataFrame, model: Model, keep: list[str], order: int = ORDER) -> DataFrame:
    """``keep`` columns, the summed log-likelihood ratio of each text, its n-grams, and the
    highest mean ratio of ``WINDOW`` n-grams in a row (over all, if there are fewer)."""
    held = docs.sparkSession.sparkContext.broadcast([vars(model.seen), vars(model.context)])  # plain data: tasks need no import
    names = [*keep, "llr", "n", "peak"]

    def run(batches):
        seen, context = (Lookup.__new__(Lookup) for _ in range(2))
        for x, parts in zip((seen, context), held.value):
            vars(x).update(parts)
        for b in batches:
            data, at = utf8(b.column(0))
            found = [np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)]
            for lo, hi in pieces(at, SLICE):
                g, doc = grams(data, at[lo : hi + 1], order)
                v, missing = seen.get(g)
                v[missing] = context.get(g[missing] >> 8)[0]
                for all_rows, part in zip(found, measured(g, doc, v, hi - lo)):
                    all_rows[lo:hi] = part
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(1, b.num_columns)), *map(pa.array, found)], names)

    own = docs.select("text", *keep)
    kept = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"{kept}llr double, n long, peak double"
    if model.tables is None:
        return own.mapInArrow(run, schema)

    def dealt(batches):
        for b in batches:
            _, at = utf8(b.column(0))
            chunk = np.zeros(b.num_rows, np.int64)
            for lo, hi in pieces(at, SLICE):
                chunk[lo:hi] = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk)], ["text", *keep, "chunk"])

    def score(texts, given):
        seen = Lookup.__new__(Lookup)
        vars(seen).update(held.value[0])
        data, at = utf8(texts.column("text"))
        g, doc = grams(data, at, order)
        v, missing = seen.get(g)
        v[missing] = Lookup(given.column("gram").to_numpy(), given.column("llr").to_numpy()).get(g[missing])[0]
        return pa.Table.from_arrays([*(texts.column(c) for c in keep), *map(pa.array, measured(g, doc, v, len(texts)))], names)

    chunks = stored(own.mapInArrow(dealt, f"text string, {kept}chunk long"))  # a chunk must not change when a task runs again
    return chunks.groupBy("chunk").cogroup(answers(chunks, held, model.tables, order).groupBy("chunk")).applyInArrow(score, schema)


def features(llr, n, peak):
    """Length-normalised ratios: per n-gram, per root of the n-grams, and at the peak, as a
    few words can make a long text toxic."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 100 * llr / n, llr / np.sqrt(n), np.log(n), 10 * peak], 1)


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    own = docs.select(F.col(id_col).alias("doc_id"), "text")
    marks = stored(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~held_out("doc_id")))
    if marks.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS:
        marks = F.broadcast(marks)
    taught = own.where("text is not null").join(marks, "doc_id")
    model = learn(taught.where(fold("doc_id") != CALIBRATION_FOLD))
    judged = score_rows(taught.where(fold("doc_id") == CALIBRATION_FOLD), model, ["doc_id", "toxic"])
    sample = judged.orderBy(F.xxhash64("doc_id"), "llr").limit(CALIBRATION_ROWS).toPandas()
    y = sample.toxic.to_numpy(float)
    if len(set(y)) < 2:
        w = None
        prior = float(y.mean()) if len(y) else 0.0
    else:
        w = [float(v) for v in calibrate(features(sample.llr.to_numpy(), sample.n.to_numpy(), sample.peak.to_numpy()), y)]
    found = score_rows(own.withColumn("held_out", held_out("doc_id")), model, ["doc_id", "held_out"])
    n = F.greatest("n", F.lit(1)).cast("double")
    if w is None:
        score = F.lit(prior)
    else:
        score = 1 / (1 + F.exp(-(F.lit(w[0]) + w[1] * 100 * F.col("llr") / n + w[2] * F.col("llr") / F.sqrt(n) + w[3] * F.log(n) + w[4] * 10 * F.col("peak"))))
    return found.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
