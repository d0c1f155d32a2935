"""SQL over named tables: reads only, told by the analysed plan and not by the text.

A statement is parsed and analysed without being run. It is refused where its plan has a command or a write anywhere, where
it names a relation that is not among the tables given, or where an expression calls Java code. What is left runs as a query
with its parameters bound by name, so that values never become SQL.
"""

from __future__ import annotations

from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
#: Classes of plans that do something beside reading, and of expressions that call outside of Spark.
WRITES = (f"{_LOGICAL}.Command", f"{_LOGICAL}.ParsedStatement", f"{_LOGICAL}.UnaryParsedStatement", f"{_LOGICAL}.InsertIntoDir", f"{_LOGICAL}.ScriptTransformation")
CALLS = ("org.apache.spark.sql.catalyst.expressions.CallMethodViaReflection",)


class RefusedError(ValueError):
    """A statement that is not a read of the tables given."""


def _each(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(k) for k in range(seq.size())]


def _plans(plan: JavaObject) -> list[JavaObject]:
    """A plan, those below it, those inside its named subqueries, and those in its expressions."""
    out, waiting = [], [plan]
    while waiting:
        now = waiting.pop()
        out.append(now)
        waiting += _each(now.children()) + _each(now.innerChildren().toSeq())
        for e in _expressions(now):
            if _is(e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                waiting.append(e.plan())
    return [p for p in out if _is(p, f"{_LOGICAL}.LogicalPlan")]


def _expressions(plan: JavaObject) -> list[JavaObject]:
    if not _is(plan, "org.apache.spark.sql.catalyst.plans.QueryPlan"):
        return []
    out, waiting = [], _each(plan.expressions().toSeq())
    while waiting:
        now = waiting.pop()
        out.append(now)
        waiting += _each(now.children())
    return out


def _is(thing: JavaObject, name: str) -> bool:
    """Whether a Java object is of a class or trait of that name."""
    kinds, seen = [thing.getClass()], set()
    while kinds:
        kind = kinds.pop()
        if kind is None or kind.getName() in seen:
            continue
        if kind.getName() == name:
            return True
        seen.add(kind.getName())
        kinds += [kind.getSuperclass(), *kind.getInterfaces()]
    return False


def checked(spark: SparkSession, statement: str, names: set[str]) -> None:
    """Raise RefusedError unless the statement only reads from the named views. Nothing is run."""
    state = spark._jsparkSession.sessionState()
    parsed = state.sqlParser().parsePlan(statement)
    for p in _plans(parsed):
        if any(_is(p, w) for w in WRITES):
            raise RefusedError(f"not a read: {p.nodeName()}")
        if _is(p, "org.apache.spark.sql.catalyst.analysis.UnresolvedRelation"):
            parts = _each(p.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names | _with_names(parsed):
                raise RefusedError(f"no such table: {'.'.join(parts)}")
        if _is(p, "org.apache.spark.sql.catalyst.analysis.UnresolvedTableValuedFunction") and _each(p.name())[-1].lower() != "range":
            raise RefusedError(f"no such table function: {_each(p.name())[-1]}")


def _with_names(plan: JavaObject) -> set[str]:
    """Names that the statement itself gives to subqueries."""
    return {pair._1().lower() for p in _plans(plan) if _is(p, f"{_LOGICAL}.UnresolvedWith") for pair in _each(p.cteRelations())}


def run(spark: SparkSession, statement: str, tables: dict[str, DataFrame], **parameters: Any) -> DataFrame:
    """The rows of one statement over tables named as given; :name in it stands for the parameter of that name.

    Tables are views for the length of the analysis only, so a statement sees no other's tables, and theirs not its.
    """
    taken = {name: spark.catalog.tableExists(name) for name in tables}
    if clash := [n for n, there in taken.items() if there]:
        raise RefusedError(f"names in use in this session: {', '.join(clash)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        checked(spark, statement, {n.lower() for n in tables})
        out = spark.sql(statement, args=parameters)
        analysed = out._jdf.queryExecution().analyzed()
        for p in _plans(analysed):
            if any(_is(p, w) for w in WRITES):
                raise RefusedError(f"not a read: {p.nodeName()}")
            if any(_is(e, c) for e in _expressions(p) for c in CALLS):
                raise RefusedError("calls outside of SQL are not allowed")
        return out
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
