"""Evidence about keys from whole tables: inclusion, orphans, uniqueness, overlap."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = ["rows_child", "null_rows", "ndv_child", "ndv_parent", "ndv_union", "orphan_keys", "orphan_rows", "max_child", "max_parent"]


def _whole_number(df: DataFrame, cols: list[str]) -> bool:
    return len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)


def _key(cols: list[str], number: bool) -> list[Column]:
    """A key as a number or as text, the other one null; both null if a part is.  Parts of several have their lengths in front, so that they can't run together."""
    if number:
        return [F.col(cols[0]).cast("long").alias("number"), F.lit(None).cast("string").alias("text")]
    parts = [F.col(c).cast("string") for c in cols]
    text = parts[0] if len(parts) == 1 else F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])
    return [F.lit(None).cast("long").alias("number"), text.alias("text")]


def _tagged(uses: list[tuple[DataFrame, list[str], bool, dict]]) -> DataFrame:
    """A row (tags, number, text) for each use (DataFrame, columns, whether they are whole numbers, tags) of each row; every DataFrame is read once, and only its key columns."""
    frames: dict[int, tuple[DataFrame, list[Column]]] = {}
    for df, cols, number, tags in uses:
        frames.setdefault(id(df), (df, []))[1].append(F.struct(*[F.lit(v).alias(k) for k, v in tags.items()], *_key(cols, number)))
    return reduce(DataFrame.unionByName, [df.select(F.explode(F.array(*structs)).alias("u")).select("u.*") for df, structs in frames.values()])


KEY = ("number", "text")


def _is_key() -> Column:
    return F.col("number").isNotNull() | F.col("text").isNotNull()


def inclusions(edges: list[tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """A row (edge, EVIDENCE, coverage) for each (child, columns, parent, columns), numbered from 0.

    One job for all of them: the keys of both sides of all edges are counted together, first within partitions, so that distinct
    keys are shuffled, once.
    """
    numbers = [_whole_number(e[0], e[1]) and _whole_number(e[2], e[3]) for e in edges]
    uses = [(df, cols, numbers[i], {"edge": i, "child": side == 0}) for i, e in enumerate(edges) for side, (df, cols) in enumerate(((e[0], e[1]), (e[2], e[3])))]
    both = _tagged(uses).groupBy("edge", *KEY).agg(F.count_if("child").alias("nc"), F.count_if(~F.col("child")).alias("np"))
    whole = _is_key()
    here, there = (F.col("nc") > 0) & whole, (F.col("np") > 0) & whole
    found = both.groupBy("edge").agg(
        F.sum("nc").alias("rows_child"),
        F.coalesce(F.sum(F.when(~whole, F.col("nc"))), F.lit(0)).alias("null_rows"),
        F.count_if(here).alias("ndv_child"),
        F.count_if(there).alias("ndv_parent"),
        F.count_if(whole).alias("ndv_union"),
        F.count_if(here & ~there).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(here & ~there, F.col("nc"))), F.lit(0)).alias("orphan_rows"),
        F.max(F.when(here, F.col("nc"))).alias("max_child"),
        F.max(F.when(there, F.col("np"))).alias("max_parent"),
    )
    return found.withColumn("coverage", F.round(F.try_divide(F.col("ndv_child") - F.col("orphan_keys"), F.col("ndv_child")), 6))


def inclusion(child: DataFrame, child_cols: list[str], parent: DataFrame, parent_cols: list[str]) -> DataFrame:
    """One row of EVIDENCE and coverage for child columns that refer to parent columns; a key with a null part is null."""
    one = inclusions([(child, child_cols, parent, parent_cols)]).drop("edge")
    zeros = {"rows_child": 0, "null_rows": 0, "ndv_child": 0, "ndv_parent": 0, "ndv_union": 0, "orphan_keys": 0, "orphan_rows": 0}
    return one.agg(*[F.coalesce(F.max(c), F.lit(zeros[c])).alias(c) if c in zeros else F.max(c).alias(c) for c in one.columns])  # a row even of nothing


def key_counts(uses: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table_name, column_name, non_null, ndv, max_freq) of key columns of several tables, exactly, in one job."""
    tagged = [(df, [c], _whole_number(df, [c]), {"table_name": t, "column_name": c}) for t, (df, cols) in uses.items() for c in cols]
    keys = _tagged(tagged).groupBy("table_name", "column_name", *KEY).agg(F.count(F.lit(1)).alias("n"))
    there = _is_key()
    return keys.groupBy("table_name", "column_name").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null"), F.count_if(there).alias("ndv"), F.max(F.when(there, F.col("n"))).alias("max_freq"))


def sketch_inclusion(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, lg_k: int = 14) -> DataFrame:
    """(ndv_child, ndv_parent, ndv_union, coverage) from mergeable sketches: one pass over each side and no join."""
    c = child.agg(F.hll_sketch_agg(F.col(child_col).cast("string"), lg_k).alias("c"))
    p = parent.agg(F.hll_sketch_agg(F.col(parent_col).cast("string"), lg_k).alias("p"))
    est = c.crossJoin(p).select(F.hll_sketch_estimate("c").alias("ndv_child"), F.hll_sketch_estimate("p").alias("ndv_parent"), F.hll_sketch_estimate(F.hll_union("c", "p")).alias("ndv_union"))
    cover = F.try_divide(F.col("ndv_child") + F.col("ndv_parent") - F.col("ndv_union"), F.col("ndv_child"))
    return est.withColumn("coverage", F.least(F.lit(1.0), F.greatest(F.lit(0.0), cover)))


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows of the child whose key isn't null and isn't in the parent."""
    keys = parent.select(F.col(parent_col).alias("__key")).filter("__key is not null").distinct()
    return child.filter(F.col(child_col).isNotNull()).join(keys, F.col(child_col) == F.col("__key"), "left_anti")


def composite_uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, n_keys, uniqueness) of the tuples of columns; tuples with nulls don't count."""
    full = df.select(columns).dropna()
    keyed = full.groupBy(columns).agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("uniqueness", F.round(F.try_divide(F.col("n_keys"), F.col("n_rows")), 6))


def union_keys(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Distinct keys of both sides with the side they come from."""
    left = a.select(F.col(a_col).cast("string").alias("key")).distinct().withColumn("side", F.lit("child"))
    right = b.select(F.col(b_col).cast("string").alias("key")).distinct().withColumn("side", F.lit("parent"))
    return left.unionAll(right)


def shared_values(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """(value): the distinct values that both columns have."""
    return a.select(F.col(a_col).alias("value")).intersect(b.select(F.col(b_col).alias("value")))


@dataclass(frozen=True)
class ColumnProfile:
    family: str
    row_count: int
    ndv: int
    non_null: int
    min_value: str | None = None
    max_value: str | None = None

    @property
    def uniqueness(self) -> float:
        return min(1.0, self.ndv / self.non_null) if self.non_null else 0.0

    @property
    def key_like(self) -> bool:
        return self.uniqueness >= 0.9 and self.ndv > 1


def can_contain(child: ColumnProfile | None, parent: ColumnProfile | None, tolerance: float = 1.05) -> bool:
    """Whether the parent's column may contain the child's; unknown profiles keep the pair."""
    if child is None or parent is None:
        return True
    if child.family != parent.family or not parent.key_like or child.ndv < 2 or child.ndv > tolerance * parent.ndv:
        return False
    if child.family == "integer" and None not in (child.min_value, child.max_value, parent.min_value, parent.max_value):
        return int(parent.min_value) <= int(child.min_value) and int(child.max_value) <= int(parent.max_value)
    return True


def cannot_reach(child: ColumnProfile, parent: ColumnProfile, share: float = 0.5, error: float = 1.15) -> bool:
    """Whether less than a share of the child's values can be in the parent, by (approximate) counts and ranges: nothing that inclusion would accept."""
    if child.ndv * share > parent.ndv * error:
        return True
    ends = (child.min_value, child.max_value, parent.min_value, parent.max_value)
    return child.family == parent.family == "integer" and None not in ends and (int(ends[0]) > int(ends[3]) or int(ends[1]) < int(ends[2]))


def can_contain_column(c, p, tolerance: float = 1.05) -> Column:
    """The same over columns; c, p: functions from a name to a column of profiles with min and max as numbers."""
    ok = (c("family") == p("family")) & (p("ndv") >= 2) & (p("ndv") >= 0.9 * p("non_null")) & (c("ndv") >= 2) & (c("ndv") <= tolerance * p("ndv"))
    return ok & ((c("family") != "integer") | ((c("lo") >= p("lo")) & (c("hi") <= p("hi"))))
