"""Every query against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lodestrata import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_its_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_repeat(spark, name):
    """Documents have no twin: a document for each key, none empty, the same in every run."""
    df = catalog.QUERIES[name](spark, SF)
    once, again = (sorted(tuple(map(str, r)) for r in catalog.QUERIES[name](spark, SF).collect()) for _ in range(2))
    assert once and once == again
    assert all(all(v not in ("", "None") for v in r) for r in once)
    assert len({r[0] for r in once}) == len(once) == df.count()
