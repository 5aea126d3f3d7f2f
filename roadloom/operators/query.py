"""Ad-hoc read-only statements over registered tables."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from roadloom.operators.profile import summarize


_GROUP_PROPERTIES = ["spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"]
#: Groups of Spark's own functions that a statement may call: they see nothing but their arguments.  The group of
#: functions that reach the JVM, files or the session (misc_funcs) is not among them, but for the ones named below.
_GROUPS = set("""
agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs datetime_funcs generator_funcs hash_funcs
json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs
""".split())
_HARMLESS = {"typeof", "uuid", "equal_null", "monotonically_increasing_id", "bitmap_bit_position", "bitmap_count"}
#: Expressions that choose what they call at a later time, or call code that is not Spark's.
_FOREIGN = re.compile("Reflection|ScalaUDF|PythonUD|UserDefined|UDAF|Invoke$|UnresolvedIdentifier|HiveGeneric|HiveSimple")
#: Nodes of Spark's parser that only read; whatever is not listed is refused.
_READING = set("""
Aggregate Deduplicate DescribeColumn DescribeRelation Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin Limit
LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample ShowColumns ShowNamespaces ShowTables Sort SubqueryAlias
Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedNamespace UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedTableOrView UnresolvedTableValuedFunction UnresolvedWith CurrentNamespace Window WithWindowDefinition
""".split())
_NAMED = {"UnresolvedRelation", "UnresolvedTableOrView"}


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan):
    """A parsed plan's nodes, with those of named and nested queries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _each(node.children()) + _each(node.innerChildren()) + _each(node.subqueries())


def _expressions(node):
    todo = _each(node.expressions())
    while todo:
        expression = todo.pop()
        yield expression
        todo += _each(expression.children())


def _check_function(spark: SparkSession, parts: list[str]) -> None:
    """Raise unless the name is that of one of Spark's own functions, in a listed group."""
    name = parts[-1].lower()
    known = None
    if len(parts) == 1:
        identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        known = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    if known is None or known.isEmpty() or known.get().getSource() != "built-in":
        raise ValueError(f"function: {'.'.join(parts)}")
    if known.get().getGroup() not in _GROUPS and name not in _HARMLESS:
        raise ValueError(f"function: {name}")


def _check_calls(spark: SparkSession, node) -> None:
    for expression in _expressions(node):
        kind = expression.getClass().getSimpleName().rstrip("$")
        if kind == "UnresolvedFunction":
            _check_function(spark, _each(expression.nameParts()))
        elif kind == "UnresolvedGenerator":
            name = expression.name()
            _check_function(spark, [*([name.database().get()] if name.database().isDefined() else []), name.funcName()])
        elif _FOREIGN.search(kind):
            raise ValueError(f"expression: {kind}")


def _check_plan(spark: SparkSession, sql: str) -> None:
    """Raise a ValueError unless Spark's own parser finds nothing but reads of known tables."""
    nodes = list(_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    kinds = [node.getClass().getSimpleName().rstrip("$") for node in nodes]
    for node, kind in zip(nodes, kinds, strict=True):
        if kind not in _READING:
            raise ValueError(f"node: {kind}")
        _check_calls(spark, node)
    own = {node.alias().lower() for node, kind in zip(nodes, kinds, strict=True) if kind == "SubqueryAlias"}
    for node, kind in zip(nodes, kinds, strict=True):
        if kind == "UnresolvedTableValuedFunction" and _each(node.name())[-1].lower() != "range":
            raise ValueError("function in FROM")
        if kind in _NAMED:
            parts = _each(node.multipartIdentifier())
            name = ".".join(f"`{p.replace('`', '``')}`" for p in parts)
            if not (len(parts) == 1 and parts[0].lower() in own) and not spark.catalog.tableExists(name):
                raise ValueError(f"unknown table: {name}")


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The statement as a DataFrame, or a ValueError if it is not read-only.

    ``SUMMARIZE <table>`` gives the table profile.  Everything else goes through Spark's parser, and only plans made of
    listed reading nodes over registered tables, with calls of Spark's own functions in listed groups, are run; no setting of the
    session is touched.
    """
    bare = without_comments_text(sql)
    words = bare.split()
    if len(words) > 1 and words[0].lower() == "summarize":
        name = " ".join(words[1:]).strip('"`')
        if not spark.catalog.tableExists(name):
            raise ValueError(f"unknown table: {name}")
        return summarize(spark.table(name))
    if not bare:
        raise ValueError("empty")
    try:
        _check_plan(spark, bare)
    except ParseException as error:
        raise ValueError("not a single statement") from error
    return spark.sql(bare)


def without_comments_text(sql: str) -> str:
    """One statement without the closing semicolons; comments are left to the parser."""
    return re.sub(r"[;\s]+$", "", sql.strip())


def run_query(spark: SparkSession, sql: str, max_rows: int, timeout: float = 20.0):
    """At most ``max_rows`` rows as a pandas frame, for a display.  Work that is still running
    after ``timeout`` seconds is cancelled."""
    df = read_only(spark, sql).limit(max_rows)
    context, group = spark.sparkContext, f"query-{uuid.uuid4().hex}"
    before = {k: context.getLocalProperty(k) for k in _GROUP_PROPERTIES}
    late = threading.Event()

    def stop():
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    context.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
    timer.start()
    try:
        return df.toPandas()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(
                f"time limit of {timeout:g} s reached") from error
        raise
    finally:
        timer.cancel()
        for k, v in before.items():
            context.setLocalProperty(k, v)
