import time

import pytest

from lodestrata.operators import operations, sqlguard

GOOD = [
    "select 1", "select copy from t", "select `delete`, 'drop' from t where upper(x) = 'INSERT'", "with c as (select x from t), d as (select * from c) select count(*) from d;",
    "select * from t join range(5) r on t.id = r.id where exists (select 1 from t u where u.id = t.id) order by 1 limit 3", "explain select x from t",
    "select id, row_number() over (partition by x order by id) from t union all select 1, 2", "select * from values (1, 2) v(a, b)", "select * from t lateral view explode(array(1, 2)) e as y",
    "select transform(array(1), v -> v + 1), (select max(id) from t) from t group by x having count(*) > 0", "select * from t pivot (count(id) for x in ('a', 'b'))", "table t", "from t |> where id > 1",
]
BAD = [
    "", " ; ", "drop table t", "select 1; delete from t", "(delete from t)", "insert into t select 1", "select java_method('java.lang.System', 'exit', 0)", "select reflect('a', 'b')",
    "select * from text.`/etc/passwd`", "select * from parquet.`/x`", "with c as (select * from csv.`/x`) select * from c", "select (select count(*) from text.`/etc/passwd`)",
    "select * from t where exists (select 1 from json.`/x`)", "select transform(array(1), v -> reflect('a', 'b')) from t", "select transform(x) using 'cat' from t", "set a = 1", "cache table t", "show tables",
    "select * from read_files('/etc')", "select * from identifier('text.`/etc/passwd`')", "select identifier('java_method')('a', 'b')", "execute immediate 'drop table t'", "begin select 1; end", "explain drop table t",
    "select * from nowhere", "select unknown_function(1)", "select input_file_name() from t", "add jar '/x'", "select own(1)", "select * from t order by java_method('a', 'b')", "merge into t using t u on true when matched then delete",
    "select * from t lateral view java_method('a') e as y", "call x()", "create table q as select 1", "select sum(id) filter (where reflect('a', 'b') is null) from t", "select * from stream t",
]


@pytest.fixture
def tables(spark):
    spark.sql("select id, 'a' as x, id as copy, id as `delete` from range(4)").createOrReplaceTempView("t")
    spark.udf.register("own", lambda x: x)
    yield
    spark.catalog.dropTempView("t")


@pytest.mark.parametrize("text", GOOD)
def test_queries_pass(spark, tables, text):
    assert sqlguard.check(spark, text) is None
    operations.safe_sql(spark, text, 2).collect()


@pytest.mark.parametrize("text", BAD)
def test_others_do_not(spark, tables, text):
    assert sqlguard.check(spark, text)
    with pytest.raises(ValueError):
        operations.safe_sql(spark, text)


def test_time_limit(spark, tables):
    assert len(sqlguard.rows(spark, "select * from t", 2)) == 3
    began = time.time()
    with pytest.raises(TimeoutError):
        sqlguard.rows(spark, "select sum(sqrt(a.id * b.id)) from range(2000000) a join range(2000000) b on a.id % 2 = b.id % 2", seconds=2)
    assert time.time() - began < 30
    assert len(sqlguard.rows(spark, "select 1 as x")) == 1
