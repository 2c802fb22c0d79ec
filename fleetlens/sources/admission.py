"""What an untrusted query text may be made of.

A text is looked at twice.  The parsed plan comes first, because analysis already computes
some constants (inline tables, limits): a call of a refused function, a program to run, or a
relation that is not a plain name ends it there.  The analysed plan comes second, with names
resolved: every node must be on the list of relational operators, every expression a built-in
of the engine, and every relation one of the given views, which are not looked into.

Text tricks such as quotes inside quoted names do not matter, since the text itself is never
searched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class RefusedText(ValueError):
    """A text that is not run because of what it would reach."""


# Functions that call methods of the JVM or read files named by a text.
REFUSED_FUNCTIONS = frozenset(
    ["reflect", "java_method", "try_reflect", "from_protobuf", "to_protobuf"]
)
# Simple class names of relational operators that an analysed query may have.
ALLOWED_NODES = frozenset(
    """Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter
    Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation
    Pivot Project Range RebalancePartitions Repartition RepartitionByExpression ResolvedHint
    ResolvedInlineTable ReturnAnswer Sample Sort Subquery SubqueryAlias Tail Union UnionLoop
    UnionLoopRef Unpivot View Window WithCTE WithWindowDefinition""".split()
)
# Expressions that run code of a session's own or methods that a text names.
REFUSED_EXPRESSIONS = frozenset(
    """ApplyFunctionExpression CallMethodViaReflection FromProtobuf PythonUDAF PythonUDF PythonUDTF
    SQLFunctionExpression ScalaAggregator ScalaUDAF ScalaUDF ToProtobuf TryReflect
    UnresolvedPolymorphicPythonUDTF V2Aggregator""".split()
)
_NODES = "org.apache.spark.sql.catalyst.plans.logical."
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
# Expressions that hold a plan.
_WITH_PLAN = frozenset(["Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"])


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _class(thing) -> str:
    return thing.getClass().getName()


def _simple(name: str) -> str:
    return name.rsplit(".", 1)[-1].rstrip("$")


def _check_parsed(root) -> None:
    nodes = [root]
    while nodes:
        node = nodes.pop()
        name = _simple(_class(node))
        if name == "UnresolvedRelation" and node.multipartIdentifier().size() != 1:
            raise RefusedText(f"relation {node.multipartIdentifier().mkString('.')} is not allowed")
        if name.startswith("ScriptTransformation"):
            raise RefusedText("running a program is not allowed")
        if "UnresolvedIdentifier" in name:
            raise RefusedText("a computed name is not allowed")
        nodes.extend(_items(node.children()))
        if name == "UnresolvedWith":
            nodes.extend(_items(node.innerChildren()))
        expressions = list(_items(node.expressions()))
        while expressions:
            expression = expressions.pop()
            said = _simple(_class(expression))
            if said == "UnresolvedFunction":
                called = str(expression.nameParts().last()).lower()
                if called in REFUSED_FUNCTIONS:
                    raise RefusedText(f"function {called} is not allowed")
            if "UnresolvedIdentifier" in said:
                raise RefusedText("a computed name is not allowed")
            if said in _WITH_PLAN:
                nodes.append(expression.plan())
            expressions.extend(_items(expression.children()))


def _check_analysed(root, views: frozenset[str]) -> None:
    nodes = [root]
    while nodes:
        node = nodes.pop()
        full = _class(node)
        name = _simple(full)
        if not full.startswith(_NODES) or name not in ALLOWED_NODES:
            raise RefusedText(f"plan node {name} is not allowed")
        if name == "View":
            table = node.desc().identifier().table()
            if not node.isTempView() or table.lower() not in views:
                raise RefusedText(f"relation {table} is not allowed")
            continue  # a given view, whatever it is made of
        nodes.extend(_items(node.children()))
        expressions = list(_items(node.expressions()))
        while expressions:
            expression = expressions.pop()
            full = _class(expression)
            said = _simple(full)
            if not full.startswith(_EXPRESSIONS) or said in REFUSED_EXPRESSIONS:
                raise RefusedText(f"expression {said} is not allowed")
            if said in _WITH_PLAN:
                nodes.append(expression.plan())
            expressions.extend(_items(expression.children()))


def admitted(spark: SparkSession, text: str, views: frozenset[str]) -> DataFrame:
    """The query of a text, after both looks.

    The text has to parse inside a subquery and inside a table expression, which commands,
    several statements, empty text and unbalanced brackets do not."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    parser.parsePlan(f"WITH checked AS (\n{text}\n) SELECT 1")
    wrapped = f"SELECT * FROM (\n{text}\n)"
    _check_parsed(parser.parsePlan(wrapped))
    query = spark.sql(wrapped)
    _check_analysed(query._jdf.queryExecution().analyzed(), views)
    return query
