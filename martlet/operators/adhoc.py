"""Guarded, read-only ad-hoc SQL over given views.

``run_adhoc`` decides on the nodes of the parsed statement, never on its words
or on a printed plan:

* the text must parse as one query: commands, DDL, scripts and a second
  statement do not;
* every node of the tree is visited, in subqueries, window definitions, hints
  and common table expressions too. Plan nodes must be of a kind on an allow
  list; table functions, ``IDENTIFIER(...)`` and parameters are not;
* a relation must be one of the given views, or a common table expression that
  is in scope where it is named, as one plain name. Files
  (``parquet.`...```) and other tables are refused;
* a function must be built in and neither call into the JVM by reflection nor
  tell about files and sessions.

Words inside string literals are ordinary text. The views exist only while the
statement is analysed. The full result is returned, lazily; row limits belong
to whoever displays it. ``describe_result`` tells empty / one scalar / N rows
apart without counting the whole result.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

#: Kinds of plan nodes that a parsed query may have.
PLAN_NODES = frozenset("""
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation
    Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedOrderedRelation UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedWith Unpivot Window WithWindowDefinition
""".split())

#: Built-in functions that reach outside the given views.
REFUSED_FUNCTIONS = frozenset("""
    reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length
    current_user session_user user current_catalog current_database current_schema version
""".split())

_CATALYST = "org.apache.spark.sql.catalyst."


def _strip_fence(text: str) -> str:
    """Drop a surrounding markdown code fence and its optional sql tag."""
    t = text.strip()
    if t.startswith("```"):
        t = t[3:]
        if t[:3].lower() == "sql" and (len(t) == 3 or t[3].isspace()):
            t = t[3:]
    if t.endswith("```"):
        t = t[:-3]
    return t.strip()


def clean_sql(sql: str) -> str:
    """The statement without a code fence and trailing semicolons."""
    text = _strip_fence(sql or "").rstrip(";").strip()
    if not text:
        raise ValueError("empty SQL statement")
    return text


def _parsed(spark: SparkSession, text: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
    except Exception as e:  # the parser's own message, as a plain error
        raise ValueError(f"not a single SELECT query: {str(e).splitlines()[0]}") from None


class _Walk:
    """Visits a parsed tree, node by node, with the names in scope."""

    def __init__(self, spark: SparkSession, allowed):
        self.gateway = spark.sparkContext._gateway
        self.allowed = {n.lower() for n in allowed}
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry
        self.builtin = registry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def _is(self, node, name: str) -> bool:
        return is_instance_of(self.gateway, node, name)

    def visit(self, node, scope: frozenset[str]) -> None:
        """Check a value of the tree and all that it holds: nodes, and
        collections, options, maps and tuples of them."""
        if not isinstance(node, JavaObject):
            return
        if self._is(node, "scala.collection.Iterable"):
            found = node.iterator()
            while found.hasNext():
                self.visit(found.next(), scope)
            return
        if self._is(node, _CATALYST + "plans.logical.LogicalPlan"):
            scope = self._plan(node, scope)
            if scope is None:
                return
        elif self._is(node, _CATALYST + "expressions.Expression"):
            self._expression(node)
            if self._is(node, _CATALYST + "expressions.SubqueryExpression"):
                self.visit(node.plan(), scope)
        elif self._is(node, "org.apache.spark.sql.types.DataType"):
            return
        if self._is(node, "scala.Product"):
            for i in range(node.productArity()):
                self.visit(node.productElement(i), scope)

    def _plan(self, node, scope: frozenset[str]) -> frozenset[str] | None:
        """Check a plan node; the scope of what it holds, None if visited."""
        kind = node.getClass().getSimpleName()
        if kind not in PLAN_NODES:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = parts.mkString(".")
            if parts.size() != 1 or name.lower() not in scope | self.allowed:
                raise ValueError(f"unknown relation: {name}")
        if kind == "UnresolvedWith":
            ctes = node.cteRelations().iterator()
            while ctes.hasNext():
                cte = ctes.next()
                name = cte._1().lower()
                self.visit(cte._2(), scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
            self.visit(node.child(), scope)
            return None
        return scope

    def _expression(self, node) -> None:
        kind = node.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind or "Parameter" in kind:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            self._function(parts.last(), parts.size())
        elif kind == "UnresolvedGenerator":
            self._function(node.name().funcName(), 2 if node.name().database().isDefined() else 1)

    def _function(self, name: str, parts: int) -> None:
        known = self.builtin.functionExists(self.identifier(name.lower()))
        if parts != 1 or not known or name.lower() in REFUSED_FUNCTIONS:
            raise ValueError(f"function not allowed: {name}")


def check_query(spark: SparkSession, text: str, allowed) -> None:
    """Refuse text that is not one query over the allowed names."""
    _Walk(spark, allowed).visit(_parsed(spark, text), frozenset())


def run_adhoc(spark: SparkSession, sql: str, views: dict | None = None) -> DataFrame:
    """Run one read-only query over the given views."""
    views = views or {}
    text = clean_sql(sql)
    check_query(spark, text, views)
    made = []
    try:
        for name, df in views.items():
            df.createTempView(name)      # raises if the session has the name
            made.append(name)
        return spark.sql(text)
    finally:
        for name in made:
            spark.catalog.dropTempView(name)


def describe_result(df: DataFrame) -> str:
    """'empty', 'name = value' for one scalar, or 'rows' (reads at most two rows)."""
    head = df.take(2)
    if not head:
        return "empty"
    if len(head) == 1 and len(df.columns) == 1:
        return f"{df.columns[0]} = {head[0][0]}"
    return "rows"
