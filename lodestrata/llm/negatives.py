"""Hard negatives by a pivot table: brackets on inner products, exact check of what they leave.

A vector x gets one more component, ``sqrt(M - |x|^2)`` with M the largest squared length, and an
anchor a gets 0: then ``|a - x|^2 = |a|^2 + M - 2 <a, x>``, so a large inner product is a small
distance.  A few vectors, picked from a bounded sample, are pivots.  The table stores every
row's distance to every pivot; by the triangle inequality a distance lies between
``|d(a, p) - d(x, p)|`` and ``d(a, p) + d(x, p)`` for each pivot p, and so does the score between two
bounds.  Rows belong to the cell of their nearest pivot, and cells to blocks of bounded
size.  A search (an anchor, a range of scores, the same or another label) is sent to the cells
whose brackets meet its range; there, pages of rows and then single rows are passed over by
the same test, and the exact scores of the others are worked out.  No row outside the range
is lost, whatever the pivots are; they only decide how much is passed over.

First an anchor's own cell is searched, which gives a bound for its positives; then the other
cells, for rows above it; then each positive's range is searched for negatives.  Per block a search
yields k rows at most, so copies never become pairs.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; of rows that share an id, the one with the smallest label (then vector) takes part; a
shorter vector is filled up with zeros; scores are exact up to 2**53; ties go to the
smaller id; an anchor without positives or negatives has no rows; an empty table has none; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import stored

PIVOTS = 16
#: Pivots are chosen among so many rows, those whose ids have the least hashes.
PIVOT_SAMPLE = 4096
BLOCK_ROWS = 1 << 16
PAGE_ROWS = 512
SEARCHES_AT_ONCE = 512
ROUTED_AT_ONCE = 1 << 14
POSITIVES, NEGATIVES = 5, 5
BEST = 1 << 62  # above any score

SEARCH = "cell int, block int, kind int, id long, tag long, label int, vec array<double>, dist array<double>, low long, high long, same boolean"


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vec): the rows that take part, with whole-numbered components as doubles."""
    vec = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label, key = F.col(label_col).cast("int"), F.col(id_col).cast("long")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    own = vectors.where(finite & key.isNotNull() & label.isNotNull()).select(key.alias("id"), F.struct(moved.alias("label"), vec.alias("vec")).alias("own"))
    return own.groupBy("id").agg(F.min("own").alias("own")).select("id", "own.*")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter lists filled up with zeros."""
    n = len(column)
    at = np.asarray(column.offsets) if n else np.zeros(1, np.int32)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if n else np.zeros(0)
    at = at - at[0]
    if n and (np.diff(at) == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    sizes = np.diff(at)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(at[:-1], sizes)] = flat
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def pivots(rows: DataFrame, width: int, most: float, count: int = PIVOTS) -> np.ndarray:
    """Far points of a sample of ``PIVOT_SAMPLE`` rows: each the farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    points = _lifted(_matrix(sample, width), most)
    chosen, nearest = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        nearest = np.minimum(nearest, _distances(points, points[chosen[-1:]])[:, 0])
        chosen.append(int(np.argmax(nearest)))
    return points[chosen]


class Cells:
    """What is known of the pivots and their cells: a few numbers for each pair of them."""

    def __init__(self, width: int, most: float, points: np.ndarray):
        self.width, self.most, self.points = width, most, points

    def measured(self, rows: DataFrame, block_rows: int) -> None:
        n = len(self.points)
        ranges = [f(F.element_at("dist", k + 1)) for f in (F.min, F.max) for k in range(n)]
        cells = rows.groupBy("cell").agg(F.count(F.lit(1)), *ranges).collect()  # one row a pivot at most
        self.cells = np.array([c[0] for c in cells], np.int32)
        self.blocks = np.array([-(-c[1] // block_rows) for c in cells], np.int64)
        self.near = np.array([c[2 : 2 + n] for c in cells])
        self.far = np.array([c[2 + n :] for c in cells])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of anchors, whose last component is 0, to the pivots."""
        return _distances(np.column_stack([x, np.zeros(len(x))]), self.points)

    def bracket(self, x: np.ndarray, d: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score of each x with rows whose pivot distances lie between ``near`` and ``far``."""
        least, largest = np.zeros((len(x), len(near))), np.full((len(x), len(near)), np.inf)
        for p in range(near.shape[1]):
            a = d[:, p, None]
            np.maximum(least, np.maximum(near[None, :, p] - a, a - far[None, :, p]), out=least)
            np.minimum(largest, a + far[None, :, p], out=largest)
        both = np.einsum("ij,ij->i", x, x)[:, None] + self.most
        slack = 1 + 1e-9 * both  # far more than rounding can do
        return (both - largest**2) / 2 - slack, (both - least**2) / 2 + slack


class PivotTable:
    """Every row with its cell, block and distances, stored."""

    def __init__(self, rows: DataFrame, count: int = PIVOTS, block_rows: int = BLOCK_ROWS):
        rows = stored(rows)
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        size = rows.agg(F.max(F.size("vec")), F.max(square)).first()
        self.empty = size[0] is None
        if self.empty:
            return
        self.known = Cells(*size, pivots(rows, *size, count))
        placed = stored(self._placed(rows))
        self.known.measured(placed, block_rows)
        of = F.create_map(*(F.lit(int(x)) for pair in zip(self.known.cells, self.known.blocks) for x in pair))
        self.rows = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(of, F.col("cell"))).cast("int"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        known = self.known

        def run(batches):
            for b in batches:
                x = _matrix(b.column("vec"), known.width)
                d = _distances(_lifted(x, known.most), known.points)
                cell = np.argmin(d, axis=1) if len(d) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _lists(x), pa.array(cell.astype(np.int32)), _lists(d)], ["id", "label", "vec", "cell", "dist"])

        return rows.select("id", "label", "vec").mapInArrow(run, "id long, label int, vec array<double>, cell int, dist array<double>")

    def search(self, searches: DataFrame, k: int, same: bool, own: bool | None = None) -> DataFrame:
        """(id, tag, found, score): for each search (id, tag, label, vec, cell, low, high) the k best rows per block.

        ``own`` True looks into the searches' own cells only, False into the others, None into all.
        """
        if self.empty:
            return searches.select("id", "tag", F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("score")).limit(0)
        route, scan = _router(self.known, same, own), _scanner(self.known, k)
        asked = searches.select("id", "tag", "label", "vec", "cell", "low", "high").mapInArrow(route, SEARCH)
        held = self.rows.selectExpr("cell", "block", "0 as kind", "id", "0L as tag", "label", "vec", "dist", "0L as low", "0L as high", "true as same")
        both = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "id", "tag")
        return both.mapInArrow(scan, "id long, tag long, found long, score long")


def _router(known: Cells, same: bool, own: bool | None):
    """Sends each search to the blocks of the cells whose brackets meet its range."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec"), known.width)
            low, high, home = (b.column(c).to_numpy() for c in ("low", "high", "cell"))
            d = known.distances(x)
            least, largest = known.bracket(x, d, known.near, known.far)
            meets = (largest >= low[:, None]) & (least <= high[:, None])
            if own is not None:
                meets &= (home[:, None] == known.cells[None]) == own
            at, cell = np.nonzero(meets)
            times = known.blocks[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            for lo in range(0, len(at), ROUTED_AT_ONCE):
                part = at[lo : lo + ROUTED_AT_ONCE]
                n, take = len(part), pa.array(part)
                given = [b.column(c).take(take) for c in ("id", "tag", "label")]
                columns = [pa.array(known.cells[cell[lo : lo + n]]), pa.array(block[lo : lo + n].astype(np.int32)), pa.array(np.ones(n, np.int32)), *given]
                columns += [_lists(x[part]), _lists(d[part]), b.column("low").take(take), b.column("high").take(take), pa.array(np.full(n, same))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEARCH.split(", ")])

    return run


def _scanner(known: Cells, k: int):
    def run(batches):
        """Blocks come one after the other, their rows before their searches."""
        at, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("cell").to_numpy().astype(np.int64) << 32 | b.column("block").to_numpy()
            kind = b.column("kind").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(key)]):
                part = b.slice(lo, hi - lo)
                if key[lo] != at:
                    at, held, block = key[lo], [], None
                if not kind[lo]:
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vec"), known.width), _matrix(part.column("dist"), len(known.points))))
                elif held or block is not None:
                    if block is None:
                        block, held = _Block(held, int(at >> 32)), []
                    for first in range(0, part.num_rows, SEARCHES_AT_ONCE):
                        yield block.searched(known, part.slice(first, SEARCHES_AT_ONCE), k)

    return run


class _Block:
    """Rows of one block, sorted by their distance to the cell's pivot and cut into pages."""

    def __init__(self, parts: list, cell: int):
        ids, labels, vec, dist = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, dist[:, cell]))
        self.ids, self.labels, self.vec, self.dist = ids[order], labels[order], vec[order], dist[order]
        at = np.arange(0, len(ids), PAGE_ROWS)
        self.pages = list(zip(at, np.r_[at[1:], len(ids)]))
        self.near, self.far = np.minimum.reduceat(self.dist, at, axis=0), np.maximum.reduceat(self.dist, at, axis=0)

    def searched(self, known: Cells, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        low, high, key, label = (asked.column(c).to_numpy().copy() for c in ("low", "high", "id", "label"))
        same = asked.column("same").to_numpy(zero_copy_only=False)
        x, d = _matrix(asked.column("vec"), known.width), _matrix(asked.column("dist"), len(known.points))
        # searches of one anchor stand together and share their scores
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        of = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        least, largest = known.bracket(x[first], d[first], self.near, self.far)
        best, found = np.full((len(key), k), -BEST), np.full((len(key), k), BEST)
        # the page with the highest bound first, so that the bounds of the searches rise early
        for page in np.argsort(-largest.max(axis=0), kind="stable"):
            lo, hi = self.pages[page]
            meets = np.flatnonzero((largest[of, page] >= low) & (least[of, page] <= high))
            if not len(meets):
                continue
            anchors, own = np.unique(of[meets], return_inverse=True)
            at = first[anchors]
            row_least, row_largest = known.bracket(x[at], d[at], self.dist[lo:hi], self.dist[lo:hi])
            ok = (row_largest[own] >= low[meets, None]) & (row_least[own] <= high[meets, None])
            ok &= (self.labels[None, lo:hi] == label[meets, None]) == same[meets, None]
            ok &= self.ids[None, lo:hi] != key[meets, None]
            rows = np.flatnonzero(ok.any(axis=0))
            if not len(rows):
                continue
            exact = np.clip(x[at] @ self.vec[lo:hi][rows].T, -float(BEST) / 2, float(BEST) / 2).astype(np.int64)[own]
            ok = ok[:, rows] & (exact >= low[meets, None]) & (exact <= high[meets, None])
            better = np.column_stack([best[meets], np.where(ok, exact, -BEST)])
            ids = np.column_stack([found[meets], np.broadcast_to(self.ids[lo:hi][rows], ok.shape)])
            ids = np.where(better == -BEST, BEST, ids)
            order = np.lexsort((ids, -better), axis=1)[:, :k]
            best[meets], found[meets] = np.take_along_axis(better, order, 1), np.take_along_axis(ids, order, 1)
            low[meets] = np.maximum(low[meets], best[meets, -1])
        at, rank = np.nonzero(best > -BEST)
        take = pa.array(at)
        return pa.RecordBatch.from_arrays([asked.column("id").take(take), asked.column("tag").take(take), pa.array(found[at, rank]), pa.array(best[at, rank])], ["id", "tag", "found", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best over all blocks, with their ranks."""
    order = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def is_anchor(key: Column) -> Column:
    return key % 100 == 0


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100, count: int = PIVOTS, block_rows: int = BLOCK_ROWS, **columns) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative has another label and a score of ``low`` to ``high`` percent of the positive's.
    """
    table = PivotTable(clean(vectors, **columns), count, block_rows)
    if table.empty:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = table.rows.where(is_anchor(F.col("id"))).select("id", "label", "vec", "cell")
    every = anchors.selectExpr("*", "0L as tag", f"-{BEST}L as low", f"{BEST}L as high")
    near = stored(_ranked(table.search(every, positives, same=True, own=True), positives))
    bound = near.where(F.col("rank") == positives).select(F.col("id").alias("bound_id"), F.col("score").alias("bound"))
    rest = every.join(bound, F.col("id") == F.col("bound_id"), "left").withColumn("low", F.coalesce("bound", "low"))
    far = table.search(rest, positives, same=True, own=False)
    best = stored(_ranked(near.drop("rank").unionByName(far), positives))
    pairs = best.select(F.col("id").alias("anchor_id"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    ranges = pairs.join(anchors, F.col("anchor_id") == F.col("id")).where("positive_score >= 0").select(
        "id", F.col("positive_id").alias("tag"), "label", "vec", "cell",
        F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"{high} * positive_score div 100").alias("high"),
    )
    found = _ranked(table.search(ranges, negatives, same=False), negatives)
    named = found.select(F.col("id").alias("a"), F.col("tag").alias("p"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(pairs, (F.col("a") == F.col("anchor_id")) & (F.col("p") == F.col("positive_id"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB's SQL, over all pairs of an anchor and a row.
SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as int) as rank,
  other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 5
"""
