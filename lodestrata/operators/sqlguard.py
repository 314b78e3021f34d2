"""A guard for queries from outside: the plan of Spark's own parser against lists of what may be in it.

A statement is a query when every node of its plan is a relational operator of ``NODES``; every
relation it reads is one of its own common table expressions or a table or view of the session's
catalog (so never a file path); every function is a built-in of the groups in ``FUNCTION_GROUPS``
(so neither reflection nor user code); and no name is worked out at run time.
"""

from __future__ import annotations

import threading
import uuid

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

NODES = set(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Intersect Except Distinct Deduplicate SubqueryAlias UnresolvedSubqueryColumnAliases
    UnresolvedRelation UnresolvedWith UnresolvedHaving WithWindowDefinition Window Generate UnresolvedTableValuedFunction OneRowRelation LocalRelation UnresolvedInlineTable
    Pivot UnresolvedPivot Unpivot UnresolvedUnpivot Sample UnresolvedHint Tail PipeOperator ExplainCommand""".split()
)
FUNCTION_GROUPS = set(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs
    predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs""".split()
)
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
SECONDS = 10.0


def _each(seq):
    found = seq.iterator()
    while found.hasNext():
        yield found.next()


class _Walk:
    def __init__(self, spark: SparkSession):
        self.spark, self.ctes, self.relations = spark, set(), []
        self.catalog = spark._jsparkSession.sessionState().catalog()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def is_a(self, node, kind: str) -> bool:
        return is_instance_of(self.spark.sparkContext._gateway, node, f"org.apache.spark.sql.catalyst.{kind}")

    def plan(self, node) -> str | None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            return f"{kind} is no part of a query"
        if kind == "ExplainCommand":
            return self.plan(node.logicalPlan())
        if kind == "UnresolvedRelation":
            self.relations.append(list(_each(node.multipartIdentifier())))
            if node.isStreaming():
                return "a stream cannot be read here"
        if kind == "UnresolvedTableValuedFunction":
            name = [str(x).lower() for x in _each(node.name())]
            if len(name) != 1 or name[0] not in TABLE_FUNCTIONS:
                return f"table function {'.'.join(name)} is not allowed"
        if kind == "UnresolvedWith":
            self.ctes |= {x._1().lower() for x in _each(node.cteRelations())}
            below = [x._2() for x in _each(node.cteRelations())]
        else:
            below = [x for x in _each(node.innerChildren()) if self.is_a(x, "plans.logical.LogicalPlan")]
        parts = (self.plan(x) for x in [*_each(node.children()), *below])
        return next((x for x in (*parts, *(self.expression(e) for e in _each(node.expressions()))) if x), None)

    def expression(self, e) -> str | None:
        kind = e.getClass().getSimpleName().rstrip("$")
        if "UnresolvedIdentifier" in kind:
            return "a name that is worked out is not allowed"
        if kind == "UnresolvedFunction":
            if reason := self.function([str(x) for x in _each(e.nameParts())]):
                return reason
        if kind == "UnresolvedGenerator":
            if reason := self.function([e.name().funcName()]):
                return reason
        if self.is_a(e, "expressions.PlanExpression") and (reason := self.plan(e.plan())):
            return reason
        return next((x for x in map(self.expression, _each(e.children())) if x), None)

    def function(self, name: list[str]) -> str | None:
        group = None
        if len(name) == 1:
            try:
                group = self.catalog.lookupFunctionInfo(self.identifier(name[0])).getGroup()
            except PySparkException:
                pass
        return None if group in FUNCTION_GROUPS else f"function {'.'.join(name)} is not allowed"

    def unknown(self) -> str | None:
        for name in self.relations:
            quoted = ".".join("`" + part.replace("`", "``") + "`" for part in name)
            if not (len(name) == 1 and name[0].lower() in self.ctes) and not self.spark.catalog.tableExists(quoted):
                return f"{'.'.join(name)} is no table of the catalog"
        return None


def check(spark: SparkSession, text: str) -> str | None:
    """Why a statement may not run, or None."""
    text = text.strip().rstrip(";").strip()
    if not text:
        return "empty statement"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        return f"not one statement of SQL: {e.getCondition()}"
    walk = _Walk(spark)
    return walk.plan(plan) or walk.unknown()


def guarded(spark: SparkSession, text: str, max_rows: int = 500) -> DataFrame:
    """The result of one query, up to one row more than ``max_rows`` to show a cut."""
    if reason := check(spark, text):
        raise ValueError(reason)
    return spark.sql(text.strip().rstrip(";")).limit(max_rows + 1)


def rows(spark: SparkSession, text: str, max_rows: int = 500, seconds: float = SECONDS) -> list[Row]:
    """The rows of a guarded query; its jobs are cancelled when its time is over."""
    result, tag, late = guarded(spark, text, max_rows), f"guarded-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return result.collect()
    except Exception as e:  # of Spark, or of the gateway to it
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
