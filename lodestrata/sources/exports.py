"""A data source of its own for exported entities: ``spark.read.format("entity_export")``.

An export is a folder of JSON lines files ``<root>/<entity>/<yyyymmdd>_<part>.jsonl``, as connectors
leave them.  Each file is a partition; filters on ``export_date`` are pushed down and decide which
files are read at all.  As a stream, the offset is the name of the last file taken, so each new file
is read once.  Rows come as Arrow batches.

Options: ``path``, ``entity``.  The columns of the given schema are read by name, missing ones are null;
``export_date`` and ``export_file`` may be among them.  Files of other names are no exports; an empty
folder has no rows.  Paths are what ``pyarrow.fs`` opens, so executors read from a shared store.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = re.compile(r"(\d{8})_[^/]*\.jsonl$")
DATE, FILE = "export_date", "export_file"
BATCH_ROWS = 4096
_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class ExportFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def export_date(path: str) -> datetime.date | None:
    found = NAME.search(path)
    try:
        return datetime.datetime.strptime(found[1], "%Y%m%d").date() if found else None
    except ValueError:
        return None


def files(root: str, entity: str) -> list[str]:
    """The exports of an entity in the order of their names, which begin with their dates."""
    store, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    found = store.get_file_info(fs.FileSelector(f"{path.rstrip('/')}/{entity}", allow_not_found=True))
    prefix = root[: len(root) - len(path)] if root.endswith(path) else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and export_date(f.path))


def batches(path: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The rows of one file; a line that is no JSON object is a row of nulls."""
    store, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    arrow = to_arrow_schema(schema)
    fixed = {DATE: export_date(path), FILE: path.rsplit("/", 1)[-1]}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([fixed[f.name]] * len(rows), f.type) if f.name in fixed else _column([r.get(f.name) for r in rows], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows: list[dict] = []
    with store.open_input_stream(own) as stream:
        import io

        for line in io.TextIOWrapper(stream, "utf-8", errors="replace"):
            if line.strip():
                rows.append(_object(line))
            if len(rows) == BATCH_ROWS:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def _object(line: str) -> dict:
    try:
        found = json.loads(line)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """The values as one type; texts keep what is no text as JSON, others are null where they do not fit."""
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values], kind)
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return pa.concat_arrays([_one(v, kind) for v in values])


def _one(value, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array([value]).cast(kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError):
        return pa.nulls(1, kind)


class ExportReader(DataSourceReader):
    def __init__(self, root: str, entity: str, schema: StructType):
        self.root, self.entity, self.schema, self.tests = root, entity, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over those that compare the export's date; Spark applies the others."""
        for f in filters:
            if getattr(f, "attribute", None) == (DATE,) and type(f) in _COMPARED:
                self.tests.append((_COMPARED[type(f)], f.value))
            elif isinstance(f, In) and f.attribute == (DATE,):
                self.tests.append((lambda a, b: a in b, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [ExportFile(p) for p in files(self.root, self.entity) if all(test(export_date(p), value) for test, value in self.tests)] or [ExportFile("")]

    def read(self, partition: ExportFile) -> Iterator[pa.RecordBatch]:
        return batches(partition.path, self.schema) if partition.path else iter([])


class ExportStream(DataSourceStreamReader):
    def __init__(self, root: str, entity: str, schema: StructType):
        self.root, self.entity, self.schema = root, entity, schema

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        known = files(self.root, self.entity)
        return {"last": known[-1].rsplit("/", 1)[-1] if known else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Files are named by date and part, so those after the last one are new."""
        return [ExportFile(p) for p in files(self.root, self.entity) if start["last"] < p.rsplit("/", 1)[-1] <= end["last"]]

    def read(self, partition: ExportFile) -> Iterator[pa.RecordBatch]:
        return batches(partition.path, self.schema)

    def commit(self, end: dict) -> None:
        pass


class EntityExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entity_export"

    def schema(self) -> str:
        return f"value string, {DATE} date, {FILE} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExportReader(self.options["path"], self.options["entity"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ExportStream(self.options["path"], self.options["entity"], schema)
