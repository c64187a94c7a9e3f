"""What an analysed query reads: every leaf and every expression, subqueries and WITH definitions included."""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame

# Nodes without children that hold no stored rows: literals of the text, references to WITH definitions (themselves walked).
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef", "EmptyRelation"}
# Nodes and expressions that run programs, or code that the text brings along or names.
_PROGRAMS = {
    "ScriptTransformation", "CallMethodViaReflection", "ScalaUDF", "ScalaAggregator", "ScalaUDAF", "PythonUDF", "PythonUDAF", "PythonUDTF",
    "UserDefinedPythonTableFunction", "SQLFunctionNode", "SQLFunctionExpression", "SQLScalarFunction", "HiveSimpleUDF", "HiveGenericUDF",
    "HiveGenericUDTF", "HiveUDAFFunction", "ApplyFunctionExpression", "V2Aggregator",
    "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
}


def _each(seq) -> Iterator:
    """The elements of a Scala collection."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _programs(expression) -> Iterator[str]:
    name = _kind(expression)
    if name in _PROGRAMS:
        yield name
    for child in _each(expression.children()):
        yield from _programs(child)


def foreign_parts(df: DataFrame, views: Collection[str]) -> list[str]:
    """What the query reads or runs beyond the session-local temporary views named, in words; empty if nothing.

    The walk goes over the plan as Spark resolved it, so a name counts as what it stands for at its place: a WITH name covers no
    table of that name elsewhere, IDENTIFIER and quoted paths count as the tables they mean. A view given is not entered; any
    other view, table, file, row-making function or program is foreign.
    """
    allowed = {v.lower() for v in views}
    found: list[str] = []
    waiting = [df._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        name = _kind(node)
        if name == "View":
            place = node.desc().identifier()
            local = node.isTempViewStoringAnalyzedPlan() and place.database().isEmpty() and place.catalog().isEmpty()
            if not local or place.table().lower() not in allowed:
                found.append(f"view {place.unquotedString()}")
            continue
        if name in _PROGRAMS:
            found.append(name)
        for expression in _each(node.expressions()):
            found += _programs(expression)
        children = [*_each(node.children()), *_each(node.subqueries())]
        if not children and name not in _OWN_LEAVES:
            found.append(f"{name}: {node.simpleString(25)}"[:120])
        waiting += children
    return found
