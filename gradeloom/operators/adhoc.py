"""Ad-hoc SQL that can only read the tables it is given.

Spark's parser and analyser say what a statement is; an allow-list of plan nodes and of expressions decides. A relation
must be one of the given tables: their views have names of this call, any other view, table or file is refused. An
expression must be what one of Spark's own functions or a statement's form makes: registered functions, aggregates and
table functions in any language are refused, even under the name of a built-in one.
Needs a classic session, whose plans can be looked at."""

from __future__ import annotations

import re
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of an analysed plan that only read, leaves without a table, and expressions that leave Spark.
NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "SubqueryAlias", "View", "LocalRelation", "OneRowRelation",
    "Window", "Generate", "Expand", "Pivot", "Unpivot", "WithCTE", "CTERelationDef", "CTERelationRef", "Range", "Tail", "LateralJoin", "Sample", "ResolvedHint", "UnresolvedHint",
}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
#: Expressions that a statement's form makes without naming a function.
FORMS = SUBQUERIES | {
    "AttributeReference", "Alias", "MultiAlias", "Literal", "Cast", "UpCast", "SortOrder", "OuterReference", "InSubquery", "In", "CaseWhen", "LambdaFunction", "NamedLambdaVariable", "GetStructField", "GetArrayItem", "GetArrayStructFields",
    "GetMapValue", "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$", "TimestampAddInterval", "DateAddInterval", "SubtractTimestamps",
    "SubtractDates", "AddMonths", "DateAddYMInterval", "TimestampAddYMInterval", "MultiplyDTInterval", "MultiplyYMInterval", "DivideDTInterval", "DivideYMInterval", "UnaryMinus", "CheckOverflow", "BaseGroupingSets", "Collate", "TempResolvedColumn", "DatetimeSub", "PivotFirst",
    # what builders of functions make where its name isn't theirs
    "Inline", "Stack", "GeneratorOuter", "StringLPad", "StringRPad", "BinaryPad", "RoundCeil", "RoundFloor", "CurrentDate", "TryEval", "ParseToTimestamp", "ParseToDate", "ToCharacter", "Sum", "Average",
}
#: Built-in functions that call what a statement names, or look outside the tables.
FORBIDDEN = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion"}
HINT = "only the first rows are shown: add a filter, an aggregate or a limit"


class Refused(ValueError):
    """A statement that is not a plain query."""


def _walk(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _builtin(spark: SparkSession) -> set[str]:
    """Class names of the expressions behind the functions that Spark itself brings, table functions included."""
    names: set[str] = set()
    analysis = spark._jvm.org.apache.spark.sql.catalyst.analysis
    for registry in (analysis.FunctionRegistry.builtin(), analysis.TableFunctionRegistry.builtin()):
        for identifier in _walk(registry.listFunction()):
            found = registry.lookupFunction(identifier)
            if found.isDefined():
                names.add(re.sub("(Expression|Generator)?Builder$", "", found.get().getClassName().rsplit(".", 1)[-1]))
    return names - FORBIDDEN


def _expression(e, views: set[str], allowed: set[str]) -> None:
    """Refuses expressions that neither a built-in function nor a statement's form makes, whatever name they were registered by."""
    name = _name(e)
    if name not in allowed:
        raise Refused(f"{name} is not allowed")
    if name in SUBQUERIES:
        _plan(e.plan(), views, allowed)
    # a built-in function that stands for others is known by what it was given
    given = any(c.getName().endswith("InheritAnalysisRules") for c in _types(e))
    for child in _walk(e.parameters() if given else e.children()):
        _expression(child, views, allowed)


def _types(e) -> list:
    found, todo = [], [e.getClass()]
    while todo:
        c = todo.pop()
        found.append(c)
        todo += [*c.getInterfaces(), *([c.getSuperclass()] if c.getSuperclass() is not None else [])]
    return found


def _plan(node, views: set[str], allowed: set[str]) -> None:
    """Refuses what isn't in the allow-list; a view of this call is as it was given, all other relations are refused."""
    name = _name(node)
    if name not in NODES:
        raise Refused(f"{name} is not allowed")
    if name == "View":
        view = node.desc().identifier().table()
        if view not in views:
            raise Refused(f"{view} is none of the given tables")
        return
    for e in _walk(node.expressions()):
        _expression(e, views, allowed)
    for child in _walk(node.children()):
        _plan(child, views, allowed)


def _said(message: str | None) -> str:
    """The first line of an error that says anything."""
    return next((line.strip() for line in (message or "").splitlines() if line.strip()), "no reason given")


def guarded(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of one reading statement over the given tables and nothing else."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        parsed = parser.parsePlan(sql)
    except Py4JJavaError as e:
        raise Refused(f"not a statement: {_said(e.java_exception.getMessage())}") from None
    except Exception as e:
        raise Refused(f"not a statement: {_said(str(e))}") from None
    jvm = spark._jvm
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", False, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    kind = _name(parsed)
    if command.isInstance(parsed) or kind.startswith(("Insert", "Create", "Replace", "Drop", "Cache", "Set")):
        raise Refused(f"{kind} is not a query")
    names = {n: f"adhoc_{n}_{uuid.uuid4().hex[:8]}" for n in tables}
    try:
        for n, df in tables.items():
            df.createOrReplaceTempView(names[n])
        with_tables = "WITH " + ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in names.items()) + f" SELECT * FROM ({sql.strip().rstrip(';')}\n)"
        try:
            result = spark.sql(with_tables)
        except Exception as e:
            raise Refused(_said(str(e))) from None
        _plan(result._jdf.queryExecution().analyzed(), set(names.values()), _builtin(spark) | FORMS)
        return result
    finally:
        for v in names.values():
            spark.catalog.dropTempView(v)


def ask(spark: SparkSession, sql: str, tables: dict[str, DataFrame], most_rows: int = 200, most_chars: int = 400, most_seconds: float = 15) -> dict:
    """columns, rows, row_count, truncated and hint of a guarded statement; cells are clipped, a slow statement is refused."""
    df = guarded(spark, sql, tables)
    clipped = [F.when(F.length(F.col(f"`{c}`").cast("string")) > most_chars, F.concat(F.substring(F.col(f"`{c}`").cast("string"), 1, most_chars), F.lit("…"))).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    context, tag, late, done = spark.sparkContext, f"adhoc-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.2):  # a job may only be submitted later
            context.cancelJobsWithTag(tag)

    timer = threading.Timer(most_seconds, stop)
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    timer.start()
    try:
        rows = df.select(*clipped).limit(most_rows + 1).collect()
    except Exception:
        if late.is_set():
            raise Refused(f"took more than {most_seconds} seconds") from None
        raise
    finally:
        done.set()
        timer.cancel()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    truncated = len(rows) > most_rows
    return {"columns": df.columns, "rows": [list(r) for r in rows[:most_rows]], "row_count": min(len(rows), most_rows), "truncated": truncated, "hint": HINT if truncated else None}
