"""Vectors of texts from an embedding service, asked in batches and again where it fails.

A client is made once for each task from a factory that can be pickled, and is asked for the vectors of
up to ``BATCH`` texts at a time.  A batch that fails is asked for again after growing pauses; one that
keeps failing is asked for text by text, so that one bad text costs the others nothing.  A text that
still fails gets no vector but the reason.

Edge cases: a null or blank text is not sent and has neither vector nor error; equal texts of a
batch are sent once; an answer of the wrong length counts as a failure; rows and extra columns stay as
they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

BATCH = 100
TRIES = 3
PAUSE = 0.5  # seconds before the second try, doubled for each further one


class Client(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def asked(client: Client, texts: list[str], tries: int, pause: float) -> list[list[float]]:
    """The vectors of a batch, or the last error."""
    for n in range(tries):
        try:
            found = client.embed(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("no try is allowed")


def vectors(client: Client, texts: list[str], tries: int, pause: float) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text of one batch."""
    try:
        return [(v, None) for v in asked(client, texts, tries, pause)]
    except Exception:
        out: list[tuple[list[float] | None, str | None]] = []
        for text in texts:
            try:
                out.append((asked(client, [text], tries, pause)[0], None))
            except Exception as error:
                out.append((None, f"{type(error).__name__}: {error}"[:500]))
        return out


def embedded(docs: DataFrame, factory: Callable[[], Client], text_col: str = "content", batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """``docs`` with ``embedding`` and ``embedding_error``."""
    own = docs.drop("embedding", "embedding_error")
    at = own.columns.index(text_col)
    added = [StructField("embedding", ArrayType(FloatType())), StructField("embedding_error", StringType())]

    def run(batches):
        client = factory()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                texts = b.column(at).to_pylist()
                sent = list(dict.fromkeys(t for t in texts if t and t.strip()))
                known = dict(zip(sent, vectors(client, sent, tries, pause))) if sent else {}
                found = [known.get(t, (None, None)) for t in texts]
                columns = [pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "embedding", "embedding_error"])

    return own.mapInArrow(run, StructType([*own.schema, *added]))


class HashingClient:
    """A stand-in for a remote service: signed hashed words, normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            hashes = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], np.int64)
            np.add.at(out[k], hashes % self.dimensions, np.where(hashes >> 31, 1, -1))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()
