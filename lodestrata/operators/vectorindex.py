"""Approximate vector search: an inverted file of k-means cells with quantised residuals.

``build`` fits cells and code books on a bounded sample (``TRAIN_ROWS`` rows, those whose ids have
the least hashes) and then files every row under its nearest cell, as a code of a few bytes for
what the cell's centre leaves, in folders by cell beside the whole vectors.  ``search`` sends
each query to its nearest cells, scores codes from a table of products per query, keeps
a multiple of k, and ranks these by their exact similarity.

Vectors count by their direction (cosine).  Edge cases: a null id, and a null, zero or non-finite
vector or one of another length than the index's, is neither filed nor finds anything; repeated rows
are filed as often as they are there, and are found once; ties go to the smaller id; an index of no
rows finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRAIN_ROWS = 1 << 16
MOST_CELLS = 4096
PARTS = 16  # bytes of a code
BLOCK_ROWS = 1 << 16
TURNS = 4  # tasks over which the queries of a block are dealt
QUERIES_AT_ONCE = 32
REFINE = 10  # candidates for each wanted row
ROUNDS = 15


class Model:
    """Centres of the cells and code books of the residuals' parts."""

    def __init__(self, width: int, cells: np.ndarray, books: np.ndarray):
        self.width, self.cells, self.books = width, cells, books

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts of equal width, filled up with zeros."""
        n, each = len(self.books), self.books.shape[2]
        return np.pad(x, ((0, 0), (0, n * each - x.shape[1]))).reshape(len(x), n, each)

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.cells)
        rest = self.parts(x - self.cells[cell])
        return cell, np.column_stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)]).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[i : i + at_once] @ centres.T - half, axis=1) for i in range(0, len(x), at_once))])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of at most k groups; a group that runs empty keeps its centre."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:k]].copy()
    for _ in range(ROUNDS):
        group = nearest(x, centres)
        size = np.bincount(group, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, group, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def directions(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the rows that can be compared."""
    starts = np.asarray(lists.offsets)
    sizes = np.diff(starts) * np.asarray(lists.is_valid())
    at = np.flatnonzero(sizes == width)
    if not len(at):
        return at, np.zeros((0, width))
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[starts[at][:, None] + np.arange(width)]
    norm = np.sqrt((x**2).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok, None]


def train(vectors: DataFrame, id_col: str, vector_col: str, cells: int | None = None, parts: int = PARTS, rows: int = TRAIN_ROWS, seed: int = 42) -> Model | None:
    """A model from a sample; None if no vector can be compared.  There are about as many cells as
    the root of the number of rows, at most ``MOST_CELLS``."""
    own = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    n = own.count()
    sample = own.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows).select(vector_col).toArrow().column(0).combine_chunks()
    sizes = np.diff(np.asarray(sample.offsets)) if len(sample) else np.zeros(0, np.int64)
    if not len(sizes):
        return None
    width = int(np.argmax(np.bincount(sizes)))
    x = directions(sample, width)[1]
    if not len(x):
        return None
    centres = kmeans(x, min(cells or max(1, round(n**0.5)), MOST_CELLS), seed)
    parts = min(parts, width)
    model = Model(width, centres, np.zeros((parts, 1, -(-width // parts))))
    rest = model.parts(x - centres[nearest(x, centres)])
    books = [kmeans(rest[:, p], 256, seed + p) for p in range(parts)]
    size = max(map(len, books))  # a book with fewer entries repeats its first
    model.books = np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), 0)]) for b in books])
    return model


def file(vectors: DataFrame, model: Model, path: str, mode: str, id_col: str, vector_col: str) -> None:
    def run(batches):
        for b in batches:
            at, x = directions(b.column(1), model.width)
            cell, codes = model.filed(x)
            ids = b.column(0).take(pa.array(at))
            codes = pa.array([c.tobytes() for c in codes], pa.binary())
            units = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * model.width).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids, codes, units, pa.array(cell.astype(np.int32))], ["id", "code", "unit", "cell"])

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).where("id is not null")
    filed = own.mapInArrow(run, "id long, code binary, unit array<double>, cell int")
    filed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", **options) -> None:
    """Writes a new index of all rows to ``path``."""
    spark = vectors.sparkSession
    model = train(vectors, id_col, vector_col, **options)
    known = [] if model is None else [("width", 0, 0, [float(model.width)])]
    if model is not None:
        known += [("cell", k, 0, c.tolist()) for k, c in enumerate(model.cells)]
        known += [("book", p, k, c.tolist()) for p, book in enumerate(model.books) for k, c in enumerate(book)]
    spark.createDataFrame(known, "kind string, a int, b int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if model is not None:
        file(vectors, model, path, "overwrite", id_col, vector_col)


def add(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Files more rows under the cells that there are."""
    model = load(vectors.sparkSession, path)
    if model is None:
        build(vectors, path, id_col, vector_col)
    else:
        file(vectors, model, path, "append", id_col, vector_col)


def load(spark: SparkSession, path: str) -> Model | None:
    """At most ``MOST_CELLS`` centres and ``PARTS`` books of 256 entries."""
    known = spark.read.parquet(f"{path}/model").orderBy("kind", "a", "b").collect()
    if not known:
        return None
    of = {kind: [r for r in known if r.kind == kind] for kind in ("width", "cell", "book")}
    books = np.array([r.centre for r in of["book"]])
    parts = 1 + of["book"][-1].a
    return Model(int(of["width"][0].centre[0]), np.array([r.centre for r in of["cell"]]), books.reshape(parts, len(books) // parts, -1))


def search(queries: DataFrame, path: str, k: int, probes: int, id_col: str = "id", vector_col: str = "embedding", refine: int = REFINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest rows that each query finds in its ``probes`` nearest cells."""
    spark = queries.sparkSession
    model = load(spark, path)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).where("id is not null").dropDuplicates(["id"])
    if model is None:
        return asked.selectExpr("id as query_id", "0 as rank", "0L as id", "0.0D as similarity").limit(0)
    wanted = k * refine

    rows = spark.read.schema("id long, code binary, unit array<double>, cell int").parquet(f"{path}/rows")
    counts = sorted((r[0], r[1]) for r in rows.groupBy("cell").agg(F.count(F.lit(1))).collect())  # a row a cell at most
    first, blocks = _blocks(counts, block_rows, len(model.cells))
    held_in = first >= 0

    def route(batches):
        for b in batches:
            at, x = directions(b.column(1), model.width)
            near = np.argsort(-(x @ model.cells.T), axis=1, kind="stable")[:, :probes]
            who, cell = np.repeat(np.arange(len(at)), near.shape[1]), near.ravel()
            who, cell = who[held_in[cell]], cell[held_in[cell]]
            times = blocks[cell]
            block = np.repeat(first[cell] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            who, cell = np.repeat(who, times), np.repeat(cell, times)
            order = np.lexsort((cell, block, who))
            who, cell, block = who[order], cell[order], block[order]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (block[1:] != block[:-1])][: len(who)])
            cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(who)].astype(np.int32)), pa.array(cell.astype(np.int32)))
            unit = x[who[new]]
            units = pa.ListArray.from_arrays(pa.array((np.arange(len(unit) + 1) * model.width).astype(np.int32)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[who[new]])), units, cells, pa.array(block[new].astype(np.int32))], ["id", "unit", "cells", "block"])

    routed = asked.mapInArrow(route, "id long, unit array<double>, cells array<int>, block int")
    needed = [r[0] for r in routed.select(F.explode("cells")).distinct().collect()]  # one row a cell at most: folders to read
    if not needed:
        return asked.selectExpr("id as query_id", "0 as rank", "0L as id", "0.0D as similarity").limit(0)
    rows = rows.where(F.col("cell").isin(needed))
    own = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
    turn = F.pmod(F.xxhash64("id"), F.lit(TURNS)).cast("int").alias("turn")
    held = rows.select(
        (own(first) + F.pmod(F.xxhash64("id"), own(blocks))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"),
        F.lit(0).alias("kind"), "id", "code", F.lit(None).cast("array<double>").alias("unit"), F.array("cell").alias("cells"),
    )
    sent = routed.select("block", turn, F.lit(1).alias("kind"), "id", F.lit(None).cast("binary").alias("code"), "unit", "cells")
    both = held.unionByName(sent).repartition("block", "turn").sortWithinPartitions("block", "turn", "kind", "id")
    found = both.mapInArrow(_scanner(model, wanted), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    some = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= wanted)
    whole = rows.select(F.col("id").alias("row_id"), F.col("unit").alias("row_unit"))
    units = asked.mapInArrow(_units(model.width), "own_id long, own_unit array<double>")
    exact = some.join(whole, F.col("id") == F.col("row_id")).join(units, F.col("query_id") == F.col("own_id"))
    product = F.aggregate(F.zip_with("row_unit", "own_unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    ranked = exact.groupBy("query_id", "id").agg(F.max(product).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _units(width: int):
    def run(batches):
        for b in batches:
            at, x = directions(b.column(1), width)
            units = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * width).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), units], ["own_id", "own_unit"])

    return run


def _blocks(counts: list[tuple[int, int]], block_rows: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block (-1: it has no rows) and the number of its blocks: cells share a
    block of up to ``block_rows`` rows, a larger cell has several of its own."""
    first, blocks, at, used = np.full(cells, -1), np.ones(cells, np.int64), 0, 0
    for cell, n in counts:
        if used and used + n > block_rows:
            at, used = at + 1, 0
        first[cell], blocks[cell] = at, -(-n // block_rows)
        at, used = (at, used + n) if n <= block_rows else (at + blocks[cell], 0)
    return first, blocks


def _scanner(model: Model, wanted: int):
    """Blocks come one after the other, a block's codes before its queries; of a query and a block
    the best rows go on, from those of its cells."""
    parts = len(model.books)

    def scored(cells, ids, codes, asked):
        at, x = directions(asked.column("unit"), model.width)
        tables = np.einsum("qpd,pkd->pqk", model.parts(x), model.books)
        here, own = np.unique(cells, return_inverse=True)
        base = np.full((len(x), len(here)), -np.inf)
        lists = asked.column("cells")
        who, cell = np.repeat(np.arange(len(x)), np.diff(np.asarray(lists.offsets))), lists.flatten().to_numpy()
        known = np.isin(cell, here)
        who, cell = who[known], cell[known]
        base[who, np.searchsorted(here, cell)] = np.einsum("nd,nd->n", x[who], model.cells[cell])
        score = base[:, own]
        for p in range(parts):
            score += tables[p][:, codes[:, p]]
        top = np.argpartition(-score, min(wanted, len(ids)) - 1, axis=1)[:, :wanted]
        best = np.take_along_axis(score, top, 1).ravel()
        ok = np.isfinite(best)
        who = asked.column("id").take(pa.array(np.repeat(at, top.shape[1])[ok]))
        return pa.RecordBatch.from_arrays([who, pa.array(ids[top].ravel()[ok]), pa.array(best[ok])], ["query_id", "id", "score"])

    def run(batches):
        at, cells, ids, codes = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("block", "turn", "kind")])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            for lo, hi in zip(starts, np.r_[starts[1:], b.num_rows]):
                part, (block, turn, kind) = b.slice(lo, hi - lo), key[:, lo]
                if (block, turn) != at:
                    at, cells, ids, codes = (block, turn), [], [], []
                if kind == 0:
                    cells.append(part.column("cells").flatten().to_numpy())
                    ids.append(part.column("id").to_numpy())
                    codes.append(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts))
                elif ids:
                    if len(ids) > 1:
                        cells, ids, codes = [np.concatenate(cells)], [np.concatenate(ids)], [np.concatenate(codes)]
                    for start in range(0, part.num_rows, QUERIES_AT_ONCE):
                        yield scored(cells[0], ids[0], codes[0], part.slice(start, QUERIES_AT_ONCE))

    return run
