from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.llm import urllist

T = datetime.fromisoformat
ENTRY = "kind string, pattern string, category string, verdict string, since timestamp"
CAPTURE = "page_id long, url string, fetched_at timestamp"


def test_as_of_join(spark):
    entries = [
        ("domain", "Bad.example", "spam", "block", T("2024-01-01")), ("domain", "bad.example", "spam", "remove", T("2024-02-01")), ("domain", "bad.example", "spam", "block", T("2024-03-01")),
        ("host", "ok.bad.example", "x", "allow", T("2024-01-15")), ("path", "site.example/a/b", "p", "block", T("2024-01-01")), ("path", "site.example/a/b", "p", "block", T("2024-01-01")),
        ("domain", "tie.example", "t", "allow", T("2024-01-01")), ("domain", "tie.example", "t", "block", T("2024-01-01")), ("domain", None, "n", "block", T("2024-01-01")), ("domain", "bad.example", None, "block", None),
    ]
    captures = [
        (1, "http://u:p@WWW.bad.example:80/x", T("2024-01-01")), (2, "http://bad.example", T("2023-12-31T23:59:59")), (3, "http://bad.example./", T("2024-02-01")), (4, "https://a.b.bad.example?q", T("2024-03-05")),
        (5, "http://ok.bad.example/", T("2024-03-05")), (6, "http://ok.bad.example/", T("2024-01-10")), (7, "http://site.example/A/b/c", T("2024-06-01")), (8, "http://site.example/a/bc", T("2024-06-01")),
        (9, "http://tie.example", T("2024-01-01")), (10, None, T("2024-01-01")), (11, "not a url", T("2024-01-01")), (12, "http://notbad.example", T("2024-01-05")), (13, "http://bad.example", None),
        (14, "http://bad.example/" + "x/" * 3000, T("2024-01-05")), (None, "http://bad.example", T("2024-01-05")), (1, "http://u:p@WWW.bad.example:80/x", T("2024-01-01")),
    ]
    c = spark.createDataFrame(captures, CAPTURE).selectExpr("*", "'y' as kind", "'z' as pattern", "1 as weight")
    got = urllist.judged(c, spark.createDataFrame(entries, ENTRY).withColumn("page_id", F.lit(1))).collect()
    assert len(got) == len(captures)
    assert sorted(str(r.page_id) for r in got if r.blocked) == sorted(["1", "1", "4", "6", "7", "14", "None"])
    by = {r.page_id: r for r in got}
    assert by[5].rule == "ok.bad.example" and by[5].n_active == 2 and by[5].categories == "spam,x"
    assert by[7].rule == "site.example/a/b" and by[4].rule_since == T("2024-03-01") and by[9].rule_kind == "domain" and not by[9].blocked


def test_empty_tables(spark):
    none, c = spark.createDataFrame([], ENTRY), spark.createDataFrame([(1, "http://a.example", T("2024-01-01"))], CAPTURE)
    assert not urllist.judged(c, none).first().blocked
    assert urllist.judged(c.limit(0), none).count() == 0


def test_deep_path_entries(spark):
    deep = "site.example/a/b/c/d/e/f"
    entries = [("path", deep, "p", "block", T("2024-01-01")), ("path", "site.example/a/b", "p", "allow", T("2024-01-01"))]
    captures = [(1, f"http://{deep}/g/h", T("2024-02-01")), (2, f"http://{deep}", T("2024-02-01")), (3, "http://site.example/a/b/c/d/e/g", T("2024-02-01")), (4, "http://site.example", T("2024-02-01"))]
    got = {r.page_id: r for r in urllist.judged(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()}
    assert {k: r.blocked for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False}
    assert got[1].rule == deep and got[1].n_active == 2 and got[3].rule == "site.example/a/b" and got[4].rule is None


def test_entries_are_normalised(spark):
    written = {
        ("path", "x.example/a/"): "http://x.example/a/b", ("domain", ".z.example"): "http://w.z.example/", ("host", "https://v.example"): "https://v.example/q", ("domain", "*.Star.example."): "http://star.example",
        ("host", "http://u:p@port.example:8080/ignored?x#y"): "http://port.example/", ("path", "https://p.example//A//b/?q=1"): "http://p.example/a/b/c", ("path", "only.example/"): "http://only.example/z", ("domain", " spaced.example "): "http://spaced.example",
    }
    entries = [(k, p, "c", "block", T("2024-01-01")) for k, p in written] + [(k, p, "c", "block", T("2024-01-01")) for k, p in [("host", ""), ("domain", "..."), ("path", "/"), ("host", "https://"), ("unknown", "v.example")]]
    captures = [(i, url, T("2024-02-01")) for i, url in enumerate(written.values())] + [(100, "http://z.examples", T("2024-02-01")), (101, "http://x.example/b", T("2024-02-01")), (102, "http://sub.v.example", T("2024-02-01"))]
    got = {r.page_id: r for r in urllist.judged(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()}
    assert {k for k, r in got.items() if r.blocked} == set(range(len(written)))
    assert got[5].rule == "p.example/a/b" and got[6].rule_kind == "host" and got[3].rule == "star.example"


def test_long_urls(spark):
    long = "http://" + ".".join(["l"] * 200) + ".long.example/" + "/".join(f"s{i}" for i in range(4000)) + "?" + "q" * 300_000
    entries = [("domain", "long.example", "c", "block", T("2024-01-01")), ("path", "a.example/" + "/".join(["d"] * 50), "c", "block", T("2024-01-01"))]
    captures = [(1, long, T("2024-02-01")), (2, "http://a.example/" + "d/" * 5000, T("2024-02-01"))]
    got = {r.page_id: r for r in urllist.judged(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()}
    assert got[1].blocked and got[1].rule == "long.example" and got[2].blocked and got[2].rule_kind == "path"
