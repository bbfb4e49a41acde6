"""Logical tables: views over base tables, and the same as SQL text.

The view ``__t`` of a table has one column for each non-aggregate field, and the base columns
that aggregates mention.  A query over views is planned by Catalyst as one with the
base tables, pruning and pushdown included.
"""

from __future__ import annotations

import dataclasses
import logging
import re

from pyspark.sql import DataFrame, SparkSession

from . import parse
from .model import BaseTable, Column, ModelError, SemanticModel, Table, column_format

log = logging.getLogger(__name__)
PREFIX = "__"


def logical_name(table: str) -> str:
    return PREFIX + table.lower()


def is_logical(name: str) -> bool:
    return name.startswith(PREFIX)


def base_name(b: BaseTable) -> str:
    return ".".join(p for p in (b.database, b.schema, b.table) if p)


def validate_column(c: Column) -> None:
    from ..functions.names import type_family

    if re.search(r"\s", c.name.strip()):
        raise ModelError(f"{c.name!r}: names have no spaces")
    if type_family(c.data_type) == "object":
        raise ModelError(f"{c.name}: columns of type {c.data_type} can't be used")


def validate_columns(table: Table) -> None:
    for c in table.fields():
        validate_column(c)


def with_passthroughs(spark: SparkSession, table: Table) -> Table:
    """Adds the base columns that aggregate fields mention, unless a field has their name."""
    table = column_format(table)
    taken = {c.name.lower(): c for c in table.columns}
    extra = []
    wanted = set()
    for c in table.columns:
        if parse.is_aggregate(spark, c.expr):
            wanted |= set(parse.references(spark, c.expr))
    for m in table.metrics:  # a metric's names are fields first, and base columns otherwise
        mentioned = parse.references(spark, m.expr) + (parse.references(spark, m.filter) if m.filter else [])
        wanted |= {r.rsplit(".", 1)[-1] for r in mentioned} - taken.keys()
    for name in sorted(wanted):
        if name not in taken:
            extra.append(Column(name=name, expr=name))
        elif taken[name].expr.strip().lower() != name:
            log.warning("%s: %s is a field of another meaning; the base column isn't added", table.name, name)
    return dataclasses.replace(table, columns=[*table.columns, *extra])


def split_aggregates(spark: SparkSession, table: Table) -> tuple[list[Column], list[Column]]:
    """(fields of a row, aggregates)."""
    rows, aggs = [], []
    for c in column_format(table).columns:
        (aggs if parse.is_aggregate(spark, c.expr) else rows).append(c)
    return rows, aggs


def projection(c: Column) -> str:
    e = parse.normalize_dialect(c.expr.strip())
    return e if e.lower() == c.name.strip().lower() else f"{e} AS {c.name}"


def direct_columns(spark: SparkSession, table: Table) -> list[Column]:
    """The fields that are nothing but a base column."""
    return [c for c in column_format(table).columns if parse.is_bare_column(spark, c.expr)]


def cte_body(spark: SparkSession, table: Table) -> str:
    rows, _ = split_aggregates(spark, with_passthroughs(spark, table))
    if not rows:
        raise ModelError(f"{table.name} has no columns")
    return f"SELECT {', '.join(projection(c) for c in rows)} FROM {base_name(table.base_table)}"


def expand_logical_tables(spark: SparkSession, sql: str, model: SemanticModel) -> str:
    """The query with a WITH for every logical table before its own."""
    own, rest = parse.split_with(sql)
    parts = [(logical_name(t.name), cte_body(spark, t)) for t in model.tables]
    clash = {n.lower() for n, _ in parts} & {n.lower() for n, _ in own}
    if clash:
        raise ModelError(f"the query defines {sorted(clash)} itself")
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in [*parts, *own]) + " " + rest


def remove_logical_tables(sql: str, tables: list[str]) -> str:
    """Drops the WITH parts of logical tables; an error without WITH, or if its first part isn't logical."""
    parts, rest = parse.split_with(sql)
    if not parts:
        raise ValueError("the query has no WITH")
    if not is_logical(parts[0][0]):
        raise ValueError("the first WITH part isn't a logical table")
    ours = {logical_name(t) for t in tables}
    kept = [(n, b) for n, b in parts if n.lower() not in ours]
    return ("WITH " + ", ".join(f"{n} AS ({b})" for n, b in kept) + " " if kept else "") + rest


def qualify(sql: str, mapping: dict[str, str]) -> str:
    """Table names after FROM and JOIN -> their full names; names of WITH parts and text in quotes stay."""
    mask = parse.masked(sql)
    local = {n.lower() for n, _ in _parts_or_none(sql)}
    known = {k.lower(): v for k, v in mapping.items()}
    out, at = [], 0
    relation = re.compile(r"\s*(`[^`]+`|\w+)(?![\w.(`])")
    after = re.compile(r"(?i)(?:\s+(?:as\s+)?(?!(?:on|using|where|join|inner|left|right|full|cross|natural|group|order|having|limit|union|lateral)\b)\w+)?\s*,")
    for start in re.finditer(r"(?i)\b(?:from|join)\s", mask):
        begin = start.end()
        while m := relation.match(mask, begin):
            name = m[1].strip("`").lower()
            if name in known and name not in local:
                out += [sql[at : m.start(1)], known[name]]
                at = m.end(1)
            comma = after.match(mask, m.end())
            if not comma:
                break
            begin = comma.end()
    return "".join(out) + sql[at:]


def _parts_or_none(sql: str) -> list[tuple[str, str]]:
    try:
        return parse.split_with(sql)[0]
    except ValueError:
        return []


def register_views(spark: SparkSession, model: SemanticModel, sources: dict[str, DataFrame] | None = None) -> None:
    """Views ``__t``; ``sources``: DataFrames in place of base tables, by logical name."""
    for t in model.tables:
        view(spark, t, (sources or {}).get(t.name)).createOrReplaceTempView(logical_name(t.name))


def view(spark: SparkSession, table: Table, source: DataFrame | None = None) -> DataFrame:
    rows, _ = split_aggregates(spark, with_passthroughs(spark, table))
    if not rows:
        raise ModelError(f"{table.name} has no columns")
    df = source if source is not None else spark.table(base_name(table.base_table))
    return df.selectExpr(*[projection(c) for c in rows])


def generated_selects(spark: SparkSession, table: Table, limit: int = 10):
    """Up to two queries that try out all fields: the rows, and the aggregates."""
    rows, aggs = split_aggregates(spark, table)
    base = base_name(table.base_table)
    out = []
    if aggs:
        out.append(f"SELECT {', '.join(projection(c) for c in aggs)} FROM {base} LIMIT {limit}")
    if rows:
        out.append(f"SELECT {', '.join(projection(c) for c in rows)} FROM {base} LIMIT {limit}")
    return out


def ensure_limit(sql: str, limit: int = 200) -> str:
    s = sql.strip().rstrip(";").rstrip()
    return s if re.search(r"(?i)\blimit\s+\d+\s*$", parse.masked(s)) else f"{s} LIMIT {limit}"
