import re

from lodestrata.operators import gold, silver

ITEMS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def test_items_are_sorted_after_one_shuffle_only(spark):
    """By order, for the ranking and the join alike: the part of a file that a task reads is not sorted."""
    rows = silver.orders(spark.createDataFrame([], ITEMS), spark.createDataFrame([], ORDERS).hint("merge"))
    plan = gold.monthly_metrics(rows)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert sum("l_orderkey" in d for d in dealt) == 1 and not any("l_linenumber" in d for d in dealt)
    own = plan[plan.index("l_orderkey"):]
    below = own[own.index("Exchange hashpartitioning(l_orderkey"):]
    assert "Sort" not in below[: below.index("Scan")] and "WindowGroupLimit" not in below[: below.index("Scan")]
