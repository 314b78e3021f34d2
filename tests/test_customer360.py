from lodestrata.operators import customer360


def test_numbers_in_documents_are_rounded_as_c_does(spark):
    values = [66.85, -66.85, 28.65, 0.15, 0.25, 0.125, 2.5, -0.04, 1234567.005, 1e18, 63.6, 0.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1)
    form = "%s: %.1f%% of %.2f (%.6f)"
    got = [r[0] for r in rows.select(customer360.said(form.replace("%s", "x"), "v", "v", "v")).collect()]
    assert got == [form % ("x", v, v, v) for v in values] + [None]
