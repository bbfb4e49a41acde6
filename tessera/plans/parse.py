"""What Catalyst's parser tells about SQL text.  The only module that reaches into the JVM session."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import ParseException
from pyspark.sql import SparkSession


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def normalize_dialect(sql: str) -> str:
    """``DATEADD('day', n, x)`` with a quoted unit -> ``date_add(x, n)``."""
    return re.sub(r"(?i)\bdateadd\(\s*'day'\s*,\s*(-?\d+)\s*,\s*([^()]*(?:\([^()]*\))?)\s*\)", lambda m: f"date_add({m[2].strip()}, {m[1]})", sql)


def parse_expression(spark: SparkSession, expr: str):
    """The JVM expression; ParseException if it isn't one."""
    from pyspark.errors.exceptions.captured import convert_exception  # noqa: F401  (makes sure conversion is installed)

    return _parser(spark).parseExpression(normalize_dialect(expr))


def is_expression(spark: SparkSession, expr: str) -> bool:
    try:
        parse_expression(spark, expr)
        return True
    except ParseException:
        return False


def is_query(spark: SparkSession, sql: str) -> bool:
    try:
        _parser(spark).parsePlan(normalize_dialect(sql))
        return True
    except ParseException:
        return False


def _walk(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def references(spark: SparkSession, expr: str) -> list[str]:
    """Sorted names of the columns that an expression mentions, in lower case (quoted ones as they are); qualifiers are kept."""
    quoted = set(re.findall(r"`([^`]+)`", expr))
    found = set()
    for n in _walk(parse_expression(spark, expr)):
        if _kind(n) == "UnresolvedAttribute":
            parts = [n.nameParts().apply(i) for i in range(n.nameParts().size())]
            found.add(".".join(p if p in quoted else p.lower() for p in parts))
    return sorted(found)


def is_bare_column(spark: SparkSession, expr: str) -> bool:
    return _kind(parse_expression(spark, expr)) == "UnresolvedAttribute"


@lru_cache(maxsize=1)
def _aggregates(spark: SparkSession) -> frozenset[str]:
    rows = spark.sql("SHOW SYSTEM FUNCTIONS").collect()
    registry = spark._jsparkSession.sessionState().catalog()
    names = set()
    for r in rows:
        try:
            ident = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(r[0])
            if registry.lookupFunctionInfo(ident).getGroup() == "agg_funcs":
                names.add(r[0].lower())
        except Exception:  # noqa: BLE001  (operators such as <=> have no identifier)
            continue
    return frozenset(names)


def is_aggregate(spark: SparkSession, expr: str) -> bool:
    """Whether an aggregate function, built in or registered by the user, occurs and no window does."""
    nodes = list(_walk(parse_expression(spark, expr)))
    if any("Window" in _kind(n) for n in nodes):
        return False
    calls = [n for n in nodes if _kind(n) == "UnresolvedFunction"]
    known = _aggregates(spark)
    return any(n.nameParts().last().lower() in known or _is_user_aggregate(spark, n.nameParts().mkString("."), n.arguments().size()) for n in calls)


def _is_user_aggregate(spark: SparkSession, name: str, arguments: int) -> bool:
    """What the analyser makes of a call of a function that isn't built in: an aggregation or a projection."""
    if name.lower() in _system_functions(spark):
        return False
    try:
        plan = spark.sql(f"SELECT {name}({', '.join(['CAST(NULL AS DOUBLE)'] * arguments)}) FROM VALUES (1) AS t(x)")._jdf.queryExecution().analyzed()
    except Exception:  # noqa: BLE001  (no such function, or not of such arguments)
        return False
    return any(_kind(n) == "Aggregate" for n in _walk(plan))


@lru_cache(maxsize=1)
def _system_functions(spark: SparkSession) -> frozenset[str]:
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())


def cte_names(spark: SparkSession, sql: str) -> list[str]:
    plan = _parser(spark).parsePlan(sql)
    if _kind(plan) != "UnresolvedWith":
        return []
    rel = plan.cteRelations()
    return [rel.apply(i)._1() for i in range(rel.size())]


@lru_cache(maxsize=1)
def reserved_words(spark: SparkSession) -> frozenset[str]:
    """All keywords of Spark SQL: none is a good name for a semantic column."""
    return frozenset(r[0].upper() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect())


# ---- text that is neither quoted nor a comment


def masked(sql: str) -> str:
    """The text with quotes and comments blanked, of the same length."""
    pattern = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/"
    return re.sub(pattern, lambda m: " " * len(m[0]), sql, flags=re.DOTALL)


def split_with(sql: str) -> tuple[list[tuple[str, str]], str]:
    """([(name, body)], rest) of a query; no parts if it has no WITH."""
    mask = masked(sql)
    start = re.match(r"\s*WITH\s+", mask, re.IGNORECASE)
    if not start:
        return [], sql.strip()
    parts, at = [], start.end()
    while True:
        head = re.compile(r"\s*(`[^`]+`|\w+)\s+AS\s*\(", re.IGNORECASE).match(mask, at)
        if not head:
            raise ValueError("a WITH that can't be read")
        depth, i = 1, head.end()
        while depth:
            if i >= len(mask):
                raise ValueError("brackets of a WITH don't match")
            depth += {"(": 1, ")": -1}.get(mask[i], 0)
            i += 1
        parts.append((head[1].strip("`"), sql[head.end() : i - 1].strip()))
        comma = re.compile(r"\s*,").match(mask, i)
        if not comma:
            return parts, sql[i:].strip()
        at = comma.end()
