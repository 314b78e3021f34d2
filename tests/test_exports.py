import json

import pytest

from lodestrata.sources import exports

SCHEMA = "VBELN string, qty long, extra string, export_date date, export_file string"


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(exports.EntityExport)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for day, part, rows in [("20240101", "0", range(3)), ("20240101", "1", range(3, 5)), ("20240205", "0", range(5, 9))]:
        save(tmp_path, day, part, [{"VBELN": f"{i:04d}", "qty": i, "extra": {"n": i}} for i in rows])
    (tmp_path / "VBAK" / "notes.txt").write_text("no export")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def save(root, day, part, rows):
    (root / "VBAK").mkdir(exist_ok=True)
    (root / "VBAK" / f"{day}_{part}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def scan(spark, root, entity="VBAK"):
    return spark.read.format("entity_export").schema(SCHEMA).option("path", root).option("entity", entity).load()


def test_rows_and_odd_lines(spark, root, tmp_path):
    save(tmp_path, "20240301", "0", ["not json", "[1]", "", json.dumps({"VBELN": 7, "qty": "many"}), json.dumps({"qty": None})])
    got = {(r.VBELN, r.qty, r.extra, str(r.export_date), r.export_file) for r in scan(spark, root).collect()}
    assert len(got) == 11 and ("0008", 8, '{"n": 8}', "2024-02-05", "20240205_0.jsonl") in got
    assert ("7", None, None, "2024-03-01", "20240301_0.jsonl") in got and (None, None, None, "2024-03-01", "20240301_0.jsonl") in got
    assert scan(spark, root, "NONE").count() == 0


@pytest.mark.parametrize("where,files,rows", [("true", 3, 9), ("export_date > date'2024-01-15'", 1, 4), ("export_date = date'2024-01-01' and qty > 1", 2, 3), ("export_date in (date'2024-01-01', date'2023-01-01')", 2, 5), ("qty = 7", 3, 1)])
def test_filters_decide_what_is_read(spark, root, where, files, rows):
    found = scan(spark, root).where(where)
    assert found.rdd.getNumPartitions() == files and found.count() == rows


def test_stream_reads_what_batch_reads(spark, root, tmp_path):
    def run():
        stream = spark.readStream.format("entity_export").schema(SCHEMA).option("path", root).option("entity", "VBAK").load()
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(once=True).start().awaitTermination(120)
        return sorted(map(str, spark.read.parquet(f"{root}/out").collect()))

    assert run() == sorted(map(str, scan(spark, root).collect()))
    save(tmp_path, "20240206", "0", [{"VBELN": "new"}])
    again = run()
    assert len(again) == 10 and again == sorted(map(str, scan(spark, root).collect()))
