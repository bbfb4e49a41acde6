"""Semantic queries: dimensions, metrics and filters by name -> one DataFrame.

Metrics of one table are aggregated at the grain of that table: every other table must be reached along
many-to-one or one-to-one relationships, so no row is counted twice.  Metrics of several tables
are aggregated each for itself and meet on the dimensions in a full outer join.

Two kinds of relationships lead further.  One over a bridge (``via``) repeats rows by nature, so it is used only if ``path`` names it: each row of the one
table then meets each row of the other one that the bridge connects it with, once.  One of a table with itself is
asked for in the dimension's name, ``table@relationship.field``: the field of the row that the table's row refers to.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import aggregation
from . import logical, parse
from .model import Metric, ModelError, Relationship, SemanticModel

HOW = {"inner": "inner", "left_outer": "left", "right_outer": "right", "full_outer": "full", "cross": "cross"}


class PathError(ModelError):
    pass


@dataclass
class SemanticQuery:
    """Names are ``table.field``; metrics may also be model metrics (bare names); ``path`` names relationships to prefer."""

    metrics: list[str]
    dimensions: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    having: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    limit: int | None = None
    path: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Step:
    relationship: Relationship
    source: str
    target: str


def _steps(model: SemanticModel, table: str, allowed: list[str]) -> list[Step]:
    """Relationships that lead from the table without repeating its rows, and those over bridges that are allowed."""
    out = []
    for r in model.relationships:
        if r.left_table == r.right_table:
            continue
        if r.via:
            if r.name in allowed and table in (r.left_table, r.right_table):
                out.append(Step(r, table, r.right_table if r.left_table == table else r.left_table))
            continue
        if r.left_table == table and r.relationship_type in ("many_to_one", "one_to_one"):
            out.append(Step(r, table, r.right_table))
        if r.right_table == table and r.relationship_type in ("one_to_many", "one_to_one"):
            out.append(Step(r, table, r.left_table))
    return out


def paths(model: SemanticModel, source: str, target: str, allowed: list[str] | None = None) -> list[list[Step]]:
    """All ways that visit no table twice, the shortest first."""
    if source == target:
        return [[]]
    found, queue = [], deque([(source, [])])
    while queue:
        at, steps = queue.popleft()
        for s in _steps(model, at, allowed or []):
            if s.target == source or any(s.target in (x.source, x.target) for x in steps):
                continue
            way = [*steps, s]
            if s.target == target:
                found.append(way)
            else:
                queue.append((s.target, way))
    return found


def choose_path(model: SemanticModel, source: str, target: str, preferred: list[str]) -> list[Step]:
    found = paths(model, source, target, preferred)
    if preferred:
        liked = [w for w in found if all(any(s.relationship.name == p for s in w) for p in preferred if any(s.relationship.name == p for v in found for s in v))]
        found = liked or found
    if not found:
        raise PathError(f"{target} can't be reached from {source} without repeating rows of {source}")
    if len(found) > 1:
        ways = " or ".join(" > ".join(s.relationship.name for s in w) for w in found)
        raise PathError(f"several ways from {source} to {target}: {ways}; name one in path")
    return found[0]


def _home(name: str) -> str:
    """``table``, or ``table@relationship``, of a field's name."""
    return name.partition(".")[0]


def _split(name: str) -> tuple[str, str]:
    table, _, column = name.partition(".")
    return table.partition("@")[0], column


def metric_of(model: SemanticModel, name: str) -> tuple[str, Metric]:
    """(table, metric): a table's metric, a field with a default aggregation, or a model metric over one table."""
    if "." in name:
        t, n = _split(name)
        table = model.table(t)
        for m in table.metrics:
            if m.name.lower() == n.lower():
                return table.name, m
        c = table.field(n)
        if c and c.default_aggregation:
            return table.name, Metric(c.name, aggregation(c.default_aggregation, c.name))
        raise ModelError(f"{name} is neither a metric nor a field with a default aggregation")
    for m in model.metrics:
        if m.name.lower() == name.lower():
            mentioned = [t.name for t in model.tables if re.search(rf"(?i)\b{re.escape(t.name)}\s*\.", parse.masked(m.expr))]
            if len(mentioned) != 1:
                raise ModelError(f"model metric {name} is over {len(mentioned)} tables; one is supported")
            bare = re.sub(rf"(?i)\b{re.escape(mentioned[0])}\s*\.\s*", "", m.expr)
            return mentioned[0], Metric(m.name, bare, filter=re.sub(rf"(?i)\b{re.escape(mentioned[0])}\s*\.\s*", "", m.filter))
    raise ModelError(f"no metric {name}")


def metric_sql(m: Metric) -> str:
    """The metric's expression; a filter goes to each aggregate as FILTER (WHERE ...)."""
    e = parse.normalize_dialect(m.expr)
    if not m.filter:
        return e
    mask, out, at = parse.masked(e), [], 0
    for call in re.finditer(r"(?i)\b(sum|avg|min|max|count|median)\s*\(", mask):
        depth, i = 1, call.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(mask[i], 0)
            i += 1
        out += [e[at:i], f" FILTER (WHERE {m.filter})"]
        at = i
    return "".join(out) + e[at:]


class Planner:
    def __init__(self, spark: SparkSession, model: SemanticModel, sources: dict[str, DataFrame] | None = None):
        self.spark, self.model, self.sources = spark, model, sources or {}

    def _view(self, table: str) -> DataFrame:
        t = self.model.table(table)
        return logical.view(self.spark, t, self.sources.get(t.name))

    def _prefixed(self, table: str, filters: list[str]) -> DataFrame:
        v = self._view(table)
        for f in filters:
            v = v.filter(parse.normalize_dialect(f))
        return v.select([F.col(c).alias(f"{table}__{c}") for c in v.columns])

    def _filter(self, text: str) -> tuple[str, str]:
        """(table, predicate): a named filter ``table.name`` or ``table: predicate``."""
        if m := re.match(r"\s*(\w+)\s*:\s*(.+)$", text, re.DOTALL):
            return self.model.table(m[1]).name, m[2]
        t, n = _split(text)
        table = self.model.table(t)
        for f in table.filters:
            if f.name.lower() == n.lower():
                return table.name, f.expr
        raise ModelError(f"no filter {text}")

    def _one(self, root: str, metrics: list[Metric], q: SemanticQuery) -> DataFrame:
        filters: dict[str, list[str]] = {}
        for f in q.filters:
            t, e = self._filter(f)
            filters.setdefault(t, []).append(e)
        wanted = dict.fromkeys([_split(d)[0] for d in q.dimensions] + list(filters))
        rows, joined = self._prefixed(root, filters.get(root, [])), {root}
        for target in wanted:
            name = self.model.table(target).name
            for s in choose_path(self.model, root, name, q.path):
                if s.target in joined:
                    continue
                r = s.relationship
                if r.via:
                    rows = self._over_bridge(rows, s, filters.get(s.target, []))
                    joined.add(s.target)
                    continue
                forward = r.left_table == s.source
                pairs = [(k.left_column, k.right_column) if forward else (k.right_column, k.left_column) for k in r.relationship_columns]
                cond = [F.col(f"{s.source}__{self._name(s.source, a)}") == F.col(f"{s.target}__{self._name(s.target, b)}") for a, b in pairs]
                # a filter on the other side makes lost rows and null rows alike: inner either way
                how = "inner" if s.target in filters else HOW[r.join_type]
                rows = rows.join(self._prefixed(s.target, filters.get(s.target, [])), cond, how)
                joined.add(s.target)
        for t in dict.fromkeys(t for t in map(_home, q.dimensions) if "@" in t):
            rows = self._with_parent(rows, t)
        dims = [F.col(f"{self._prefix(t)}__{self._name(t.split('@')[0], c)}").alias(c) for t, c in ((_home(d), _split(d)[1]) for d in q.dimensions)]
        own = [f"{root}__{c}" for c in self._view(root).columns]
        flat = rows.select(*[d for d in dims], *[F.col(c).alias("m__" + c.split("__", 1)[1]) for c in own])
        back = flat.select(*[c for _, c in map(_split, q.dimensions)], *[F.col("m__" + c.split("__", 1)[1]) for c in own])
        aggs = [F.expr(self._renamed(root, metric_sql(m))).alias(m.name) for m in metrics]
        keys = [c for _, c in map(_split, q.dimensions)]
        return back.groupBy(*keys).agg(*aggs) if keys else back.agg(*aggs)

    def _prefix(self, table: str) -> str:
        name, at, relationship = table.partition("@")
        return self.model.table(name).name + at + relationship

    def _over_bridge(self, rows: DataFrame, s: Step, filters: list[str]) -> DataFrame:
        """Rows with those of the target that the bridge connects them with, each pair once."""
        via, r = self.model.table(s.relationship.via).name, s.relationship
        ends = []
        for end in (s.source, s.target):
            found = [x for x in self.model.relationships if x.left_table == via and x.right_table == end and not x.via and len(x.relationship_columns) == 1]
            columns = {k.left_column for k in r.relationship_columns} | {k.right_column for k in r.relationship_columns}
            liked = [x for x in found if x.relationship_columns[0].left_column in columns] or found
            if len(liked) != 1:
                raise PathError(f"{len(liked)} relationships lead from {via} to {end}")
            ends.append(liked[0].relationship_columns[0])
        pairs = self._view(via).select(*[F.col(self._name(via, k.left_column)).alias(f"{via}__{i}") for i, k in enumerate(ends)]).dropna().distinct()
        rows = rows.join(pairs, F.col(f"{s.source}__{self._name(s.source, ends[0].right_column)}") == F.col(f"{via}__0"))
        return rows.join(self._prefixed(s.target, filters), F.col(f"{via}__1") == F.col(f"{s.target}__{self._name(s.target, ends[1].right_column)}")).drop(f"{via}__0", f"{via}__1")

    def _with_parent(self, rows: DataFrame, dimension: str) -> DataFrame:
        """Rows of a table with the row that each refers to, in columns of their own."""
        name, _, wanted = dimension.partition("@")
        name = self.model.table(name).name
        r = next((x for x in self.model.relationships if x.name.lower() == wanted.lower() and x.left_table == x.right_table == name), None)
        if r is None:
            raise PathError(f"{name} has no relationship {wanted} with itself")
        v = self._view(name)
        parent = v.select([F.col(c).alias(f"{name}@{wanted}__{c}") for c in v.columns])
        same = [F.col(f"{name}__{self._name(name, k.left_column)}") == F.col(f"{name}@{wanted}__{self._name(name, k.right_column)}") for k in r.relationship_columns]
        return rows.join(parent, same, "left")

    def _name(self, table: str, column: str) -> str:
        t = self.model.table(table)
        if c := t.field(column):
            return c.name
        for c in t.fields():
            if c.expr.strip().lower() == column.lower():
                return c.name
        return column

    def _renamed(self, root: str, e: str) -> str:
        """Column names of the root -> their names in the flat rows, so that dimensions of the same name don't clash."""
        names = {c.lower() for c in self._view(root).columns}
        mask = parse.masked(e)
        return re.sub(r"\w+", lambda m: f"m__{m[0]}" if m[0].lower() in names and mask[m.start() : m.end()] == m[0] and not mask[m.end() :].lstrip().startswith("(") else m[0], e)

    def run(self, q: SemanticQuery) -> DataFrame:
        by_root: dict[str, list[Metric]] = {}
        for name in q.metrics:
            t, m = metric_of(self.model, name)
            by_root.setdefault(t, []).append(m)
        keys = [c for _, c in map(_split, q.dimensions)]
        if len(set(keys)) < len(keys):
            raise ModelError("two dimensions have the same name")
        parts = [self._one(root, metrics, q) for root, metrics in by_root.items()]
        if len(parts) == 1:
            out = parts[0]
        elif keys:
            out = reduce(lambda a, b: _merge(a, b, keys), parts)
        else:
            out = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
        for h in q.having:
            out = out.filter(h)
        if q.order_by:
            out = out.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in q.order_by])
        return out.limit(q.limit) if q.limit is not None else out


def _merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which null dimensions meet."""
    r = b.select(*[F.col(k).alias(f"r__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r__{k}")) for k in keys])
    rest = [c for c in [*a.columns, *b.columns] if c not in keys]
    return a.join(r, cond, "full_outer").select(*[F.coalesce(F.col(k), F.col(f"r__{k}")).alias(k) for k in keys], *rest)


def join_tables(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A declared relationship as a join; column names must not clash."""
    if how == "cross":
        return left.crossJoin(right)
    return left.join(right, [left[a] == right[b] for a, b in keys], HOW.get(how, how))


def bridge_join(a: DataFrame, bridge: DataFrame, b: DataFrame, to_a: tuple[str, str], to_b: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b that the bridge connects, each once; (bridge column, other column)."""
    pairs = bridge.select(F.col(to_a[0]).alias("__a"), F.col(to_b[0]).alias("__b")).dropna().distinct()
    return a.join(pairs, a[to_a[1]] == F.col("__a")).join(b, b[to_b[1]] == F.col("__b")).drop("__a", "__b")


def run_verified_queries(spark: SparkSession, model: SemanticModel, limit: int = 200) -> dict[str, DataFrame]:
    return {q.name: spark.sql(logical.ensure_limit(parse.normalize_dialect(q.sql), limit)) for q in model.verified_queries}
