"""The registered queries and the SQL of each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import names as N
from .operators import discover as D
from .operators import filters as SF
from .operators import inclusion as I
from .operators import profile as P
from .operators.fingerprint import fingerprint
from .plans import logical, partner
from .plans.model import BaseTable, Column, Metric, NamedFilter, RelationKey, Relationship, SemanticModel, Table
from .plans.query import Planner, SemanticQuery, bridge_join, join_tables
from .sources import catalog
from .streaming.incremental import windowed_profile

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RELATIONAL = "region nation customer supplier part orders lineitem".split()
EDGES = [
    tuple(re.split("[.>]", e))
    for e in (
        "orders.o_custkey>customer.c_custkey lineitem.l_orderkey>orders.o_orderkey lineitem.l_partkey>part.p_partkey lineitem.l_suppkey>supplier.s_suppkey "
        "customer.c_nationkey>nation.n_nationkey supplier.s_nationkey>nation.n_nationkey nation.n_regionkey>region.r_regionkey labels.doc_id>documents.doc_id"
    ).split()
]
KEY_COLUMNS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
REVENUE = "sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))))"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def frames(spark, sf_dir, names=RELATIONAL) -> dict[str, DataFrame]:
    return catalog.parquet_tables(spark, sf_dir, names)


def tpch_model() -> SemanticModel:
    """The relational tables as a semantic model."""
    dim = lambda *names: [Column(n, n) for n in names]
    base = lambda n: BaseTable("", "", n)
    tables = [
        Table("region", base("region"), dimensions=dim("r_regionkey", "r_name")),
        Table("nation", base("nation"), dimensions=dim("n_nationkey", "n_name", "n_regionkey")),
        Table("customer", base("customer"), dimensions=dim("c_custkey", "c_nationkey", "c_mktsegment"), facts=[Column("c_acctbal", "c_acctbal", default_aggregation="avg")], metrics=[Metric("n_customers", "count(c_custkey)")]),
        Table("supplier", base("supplier"), dimensions=dim("s_suppkey", "s_name", "s_nationkey")),
        Table("part", base("part"), dimensions=dim("p_partkey", "p_brand", "p_type", "p_size")),
        Table(
            "orders", base("orders"), dimensions=dim("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), time_dimensions=[Column("o_orderdate", "o_orderdate", "TIMESTAMP_NTZ"), Column("order_year", "year(o_orderdate)", "INT")],
            facts=[Column("o_totalprice", "o_totalprice", "DOUBLE")], metrics=[Metric("n_orders", "count(o_orderkey)"), Metric("buyers", "count(distinct o_custkey)"), Metric("open_orders", "count(o_orderkey)", filter="o_orderstatus = 'O'")],
            filters=[NamedFilter("finished", "o_orderstatus IN ('F', 'P')")],
        ),
        Table(
            "lineitem", base("lineitem"), dimensions=dim("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"), time_dimensions=dim("l_shipdate"),
            facts=[Column("quantity", "l_quantity", "DOUBLE"), Column("price", "cast(l_extendedprice as decimal(12,2))"), Column("discount", "cast(l_discount as decimal(4,2))")],
            metrics=[Metric("revenue", "cast(sum(price * (1 - discount)) as double)"), Metric("n_lines", "count(*)"), Metric("returned", "count(*)", filter="l_returnflag = 'R'")],
        ),
    ]
    rel = lambda n, a, ac, b, bc, how="inner": Relationship(n, a, b, [RelationKey(ac, bc)], how)
    return SemanticModel(
        "trade", tables=tables, metrics=[Metric("total_revenue", "cast(sum(lineitem.price * (1 - lineitem.discount)) as double)")],
        relationships=[rel(f"{a}_{b}", a, ac, b, bc, "left_outer" if b == "region" else "inner") for a, ac, b, bc in EDGES[:-1]],
    )


def planner(spark, sf_dir) -> Planner:
    return Planner(spark, tpch_model(), frames(spark, sf_dir))


# ---- flagship and semantic queries


@query(
    "semantic_revenue_by_segment_nation",
    f"SELECT c_mktsegment, n_name, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def semantic_revenue_by_segment_nation(spark, sf_dir):
    return planner(spark, sf_dir).run(SemanticQuery(["lineitem.revenue"], ["customer.c_mktsegment", "nation.n_name"], path=["customer_nation"]))


@query(
    "semantic_over_discovered_edges",
    f"SELECT c_mktsegment, r_name, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
)
def semantic_over_discovered_edges(spark, sf_dir):
    """The relationships come from discovery, not from the model."""
    f, model = frames(spark, sf_dir), tpch_model()
    model.relationships = D.discover_from_frames(f).relationships()
    return Planner(spark, model, f).run(SemanticQuery(["total_revenue"], ["customer.c_mktsegment", "region.r_name"], path=["customer_to_nation"])).withColumnRenamed("total_revenue", "revenue")


@query(
    "semantic_two_roots",
    "SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, n_orders, n_customers FROM (SELECT c_mktsegment, count(o_orderkey) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) a FULL JOIN (SELECT c_mktsegment, count(c_custkey) AS n_customers FROM customer GROUP BY 1) b ON a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment",
)
def semantic_two_roots(spark, sf_dir):
    return planner(spark, sf_dir).run(SemanticQuery(["orders.n_orders", "customer.n_customers"], ["customer.c_mktsegment"]))


@query("semantic_named_filter", "SELECT order_year, count(*) AS n_orders, count(DISTINCT o_custkey) AS buyers FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders WHERE o_orderstatus IN ('F', 'P')) GROUP BY 1")
def semantic_named_filter(spark, sf_dir):
    return planner(spark, sf_dir).run(SemanticQuery(["orders.n_orders", "orders.buyers"], ["orders.order_year"], ["orders.finished"]))


@query("metric_filtered", "SELECT l_linestatus, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def metric_filtered(spark, sf_dir):
    return planner(spark, sf_dir).run(SemanticQuery(["lineitem.n_lines", "lineitem.returned"], ["lineitem.l_linestatus"]))


@query("semantic_having_top", "SELECT p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING revenue > 1000 ORDER BY revenue DESC, p_brand LIMIT 10")
def semantic_having_top(spark, sf_dir):
    """A top-k report."""
    return planner(spark, sf_dir).run(SemanticQuery(["lineitem.revenue"], ["part.p_brand"], having=["revenue > 1000"], order_by=["-revenue", "p_brand"], limit=10))


# ---- catalog and profile


@query(
    "catalog_columns",
    "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal, CASE WHEN data_type LIKE '%[]' THEN 'object' WHEN data_type = 'VARCHAR' THEN 'categorical' WHEN data_type LIKE 'TIMESTAMP%' THEN 'time' ELSE 'numeric' END AS family FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")",
)
def catalog_columns(spark, sf_dir):
    return catalog.columns(spark, frames(spark, sf_dir, TABLES)).select("table_name", "column_name", "ordinal", "family")


def _profile_sql(tables: dict[str, list[tuple[str, str]]]) -> str:
    def text(c, kind):
        return {"d": f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)", "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"CAST({c} AS VARCHAR)")

    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS ndv, count({c}) AS non_null, {text(f'min({c})', k)} AS min_value, {text(f'max({c})', k)} AS max_value FROM {t}" for t, cols in tables.items() for c, k in cols
    )


PROFILED = {
    "region": [("r_regionkey", "i"), ("r_name", "s")], "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "d"), ("c_mktsegment", "s")], "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "d")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"), ("p_retailprice", "d")],
    "orders": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "d"), ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", "d"), ("l_extendedprice", "d"), ("l_discount", "d"), ("l_tax", "d"), ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
}


@query("profile_exact", _profile_sql(PROFILED))
def profile_exact(spark, sf_dir):
    return P.profile_tables(frames(spark, sf_dir))


@query("profile_approx")
def profile_approx(spark, sf_dir):
    return P.profile_tables(frames(spark, sf_dir), exact=False)


@query("profile_sampled")
def profile_sampled(spark, sf_dir):
    """A sampling operator: statistics of a tenth of the rows."""
    return P.profile(frames(spark, sf_dir, ["lineitem"])["lineitem"], exact=False, fraction=0.1, seed=7)


@query(
    "sample_values",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS position, v AS value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL) QUALIFY position <= 10"
        for t, c in (("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("orders", "o_orderkey"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"))
    ),
)
def sample_values(spark, sf_dir):
    """A sampling operator: the first ten values of each column."""
    f = frames(spark, sf_dir)
    one = lambda t, cols: catalog.sample_values(f[t], 10, cols).select(F.lit(t).alias("table_name"), "column_name", "position", "value")
    return one("customer", ["c_custkey", "c_name", "c_mktsegment"]).unionByName(one("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


@query("distinct_values", "SELECT DISTINCT 'event_type' AS column_name, event_type AS value FROM events UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer")
def distinct_values(spark, sf_dir):
    f = frames(spark, sf_dir, ["events", "customer"])
    return f["events"].select(F.lit("event_type").alias("column_name"), F.col("event_type").alias("value")).distinct().unionAll(f["customer"].select(F.lit("c_mktsegment").alias("column_name"), F.col("c_mktsegment").alias("value")).distinct())


@query("uniqueness_ratio", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness, count(DISTINCT {c}) >= 2 AND count(DISTINCT {c}) / count({c}) >= 0.9 AS key_like FROM {t}" for t, cols in KEY_COLUMNS.items() for c in cols))
def uniqueness_ratio(spark, sf_dir):
    f = frames(spark, sf_dir)
    parts = [P.uniqueness(P.profile(f[t], cols)).select(F.lit(t).alias("table_name"), "column_name", "uniqueness", "key_like") for t, cols in KEY_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("null_probe", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) > count({c}) AS has_null, round(1 - count({c}) / count(*), 6) AS null_ratio, round(count(*) FILTER (WHERE {c} IS NULL OR upper(trim(CAST({c} AS VARCHAR))) IN ('', 'NULL', 'NONE', 'NAN', 'NA', 'N/A', 'NOT AVAILABLE')) / count(*), 6) AS nullish_ratio FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def null_probe(spark, sf_dir):
    return P.null_probe(frames(spark, sf_dir)["orders"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("value_frequency_skew", " UNION ALL ".join(f"SELECT '{c}' AS column_name, max(n) AS max_freq, min(n) AS min_freq, round(max(n) / min(n), 6) AS skew FROM (SELECT count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")))
def value_frequency_skew(spark, sf_dir):
    return P.frequency_skew(frames(spark, sf_dir)["lineitem"], ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])


@query("affix_consistency", "WITH v AS (SELECT c_name AS v FROM customer WHERE c_name <> ''), a AS (SELECT s.side, s.affix FROM v, LATERAL (SELECT unnest([" + ", ".join(x for k in (1, 2, 3) for x in (f"{{'side': 'prefix', 'affix': left(v, {k})}}", f"{{'side': 'suffix', 'affix': right(v, {k})}}")) + "]) AS s)) SELECT side, affix, round(count(*) / (SELECT count(*) FROM v), 6) AS share FROM a GROUP BY 1, 2 ORDER BY share DESC, length(affix) DESC, side, affix LIMIT 1")
def affix_consistency(spark, sf_dir):
    """The top-1 affix of all customer names."""
    return P.affix_consistency(frames(spark, sf_dir)["customer"], "c_name")


# ---- keys and inclusion

_KEYS = [(t, f, k) for t, cols in PROFILED.items() for f, k in cols]


@query("key_candidates")
def key_candidates(spark, sf_dir):
    """Columns that can be keys, from metadata alone."""
    raws = catalog.tables_from_frames(frames(spark, sf_dir))
    rows = [(t.name, c.name) for t in raws for c in D.key_prefilter(t).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


@query("pk_candidates")
def pk_candidates(spark, sf_dir):
    """By name, with exact uniqueness over the whole tables as veto."""
    f = frames(spark, sf_dir)
    raws = catalog.tables_from_frames(f)
    for t in raws:
        cols = [c.name for c in D.key_prefilter(t).columns]
        for r in P.profile(f[t.name], cols).collect():
            t.column(r["column_name"]).uniqueness = r["ndv"] / r["non_null"] if r["non_null"] else None
    rows = [(k.table, ",".join(k.columns), k.source) for t in raws if (k := D.primary_key(t, raws))]
    return spark.createDataFrame(rows, "table_name string, column_name string, pk_source string")


def _inclusion_sql(child, cc, parent, pc) -> str:
    return (
        f"SELECT '{child}.{cc}' AS child, '{parent}.{pc}' AS parent, (SELECT count(*) FROM {child}) AS rows_child, (SELECT count(*) FROM {child} WHERE {cc} IS NULL) AS null_rows, (SELECT count(DISTINCT {cc}) FROM {child}) AS ndv_child, (SELECT count(DISTINCT {pc}) FROM {parent}) AS ndv_parent,"
        f" (SELECT count(*) FROM (SELECT {cc} FROM {child} WHERE {cc} IS NOT NULL UNION SELECT {pc} FROM {parent} WHERE {pc} IS NOT NULL)) AS ndv_union,"
        f" (SELECT count(DISTINCT {cc}) FROM {child} WHERE {cc} NOT IN (SELECT {pc} FROM {parent} WHERE {pc} IS NOT NULL)) AS orphan_keys, (SELECT count(*) FROM {child} WHERE {cc} NOT IN (SELECT {pc} FROM {parent} WHERE {pc} IS NOT NULL)) AS orphan_rows,"
        f" (SELECT max(n) FROM (SELECT count(*) AS n FROM {child} WHERE {cc} IS NOT NULL GROUP BY {cc})) AS max_child, (SELECT max(n) FROM (SELECT count(*) AS n FROM {parent} WHERE {pc} IS NOT NULL GROUP BY {pc})) AS max_parent,"
        f" round(1 - (SELECT count(DISTINCT {cc}) FROM {child} WHERE {cc} NOT IN (SELECT {pc} FROM {parent} WHERE {pc} IS NOT NULL)) / (SELECT count(DISTINCT {cc}) FROM {child}), 6) AS coverage"
    )


TRAP = ("events", "user_id", "customer", "c_custkey")


def _included(f: dict[str, DataFrame], edges: list[tuple]) -> DataFrame:
    """(child, parent, evidence) of all edges, in one job."""
    found = I.inclusions([(f[a], [ac], f[b], [bc]) for a, ac, b, bc in edges])
    name = lambda x: F.element_at(F.array(*[F.lit(n) for n in x]), F.col("edge") + 1)
    return found.select(name([f"{a}.{ac}" for a, ac, _, _ in edges]).alias("child"), name([f"{b}.{bc}" for _, _, b, bc in edges]).alias("parent"), "*").drop("edge")


@query("inclusion_coverage", " UNION ALL ".join(_inclusion_sql(*e) for e in [*EDGES, TRAP]))
def inclusion_coverage(spark, sf_dir):
    return _included(frames(spark, sf_dir, TABLES), [*EDGES, TRAP])


@query("inclusion_sketch")
def inclusion_sketch(spark, sf_dir):
    f = frames(spark, sf_dir, TABLES)
    parts = [I.sketch_inclusion(f[a], ac, f[b], bc).select(F.lit(f"{a}.{ac}").alias("child"), F.lit(f"{b}.{bc}").alias("parent"), "*") for a, ac, b, bc in EDGES]
    return reduce(DataFrame.unionByName, parts)


@query("orphan_rows", " UNION ALL ".join(f"SELECT '{a}.{ac}' AS child, count(*) AS orphan_rows FROM {a} WHERE {ac} IS NOT NULL AND {ac} NOT IN (SELECT {bc} FROM {b} WHERE {bc} IS NOT NULL)" for a, ac, b, bc in EDGES + [("documents", "doc_id", "labels", "doc_id")]))
def orphan_rows(spark, sf_dir):
    f = frames(spark, sf_dir, TABLES)
    parts = [I.orphans(f[a], ac, f[b], bc).agg(F.count("*").alias("orphan_rows")).select(F.lit(f"{a}.{ac}").alias("child"), "orphan_rows") for a, ac, b, bc in EDGES + [("documents", "doc_id", "labels", "doc_id")]]
    return reduce(DataFrame.unionByName, parts)


@query("composite_uniqueness", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, round(count(*) / sum(n), 6) AS uniqueness FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def composite_uniqueness(spark, sf_dir):
    return I.composite_uniqueness(frames(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber"])


_INT_COLUMNS = [(t, c) for t, cols in PROFILED.items() for c, k in cols if k == "i"]


@query(
    "candidate_prune",
    "WITH p AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) AS ndv, count({c}) AS nn, CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi FROM {t}" for t, c in _INT_COLUMNS) + ") SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column FROM p a JOIN p b ON a.t <> b.t AND b.ndv >= 2 AND b.ndv >= 0.9 * b.nn AND a.ndv >= 2 AND a.ndv <= 1.05 * b.ndv AND a.lo >= b.lo AND a.hi <= b.hi",
)
def candidate_prune(spark, sf_dir):
    """Column pairs that counts and ranges leave for inclusion joins; profiles are a row a column, so their cross product is small."""
    f = frames(spark, sf_dir)
    parts = [P.profile(f[t], [c for x, c in _INT_COLUMNS if x == t]).select(F.lit(t).alias("t"), F.col("column_name").alias("c"), F.lit("integer").alias("family"), "ndv", "non_null", F.col("min_value").cast("long").alias("lo"), F.col("max_value").cast("long").alias("hi")) for t in f]
    p = reduce(DataFrame.unionByName, parts)
    a, b = p.alias("a"), p.alias("b")
    ok = I.can_contain_column(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"))
    return a.join(b, (F.col("a.t") != F.col("b.t")) & ok).select(F.col("a.t").alias("child_table"), F.col("a.c").alias("child_column"), F.col("b.t").alias("parent_table"), F.col("b.c").alias("parent_column"))


@query("union_keys", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key, 'child' AS side FROM orders UNION ALL SELECT DISTINCT CAST(c_custkey AS VARCHAR), 'parent' FROM customer")
def union_keys(spark, sf_dir):
    f = frames(spark, sf_dir)
    return I.union_keys(f["orders"], "o_custkey", f["customer"], "c_custkey")


@query("overlap_intersect", "SELECT count(*) AS shared FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)")
def overlap_intersect(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f["supplier"].select("s_nationkey").intersect(f["customer"].select("c_nationkey")).agg(F.count("*").alias("shared"))


# ---- names


def _name_pairs(spark):
    names = sorted({c for cols in KEY_COLUMNS.values() for c in cols})
    return spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")


_NAMES = "(VALUES " + ", ".join(f"('{c}')" for c in sorted({c for cols in KEY_COLUMNS.values() for c in cols})) + ") v(c)"


@query("name_distance", f"SELECT x.c AS a, y.c AS b, CAST(levenshtein(x.c, y.c) AS INTEGER) AS distance FROM {_NAMES.replace('v(c)', 'x(c)')} JOIN {_NAMES.replace('v(c)', 'y(c)')} ON x.c < y.c")
def name_distance(spark, sf_dir):
    return _name_pairs(spark).select("a", "b", F.levenshtein("a", "b").alias("distance"))


_CORE = lambda c: f"regexp_replace(regexp_replace(lower({c}), '^[a-z0-9]{{1,2}}_', ''), '_?(key|id|num|no)$', '')"


@query("name_similarity", f"SELECT x.c AS a, y.c AS b, CASE WHEN {_CORE('x.c')} = {_CORE('y.c')} AND {_CORE('x.c')} <> '' THEN 0.95::DOUBLE ELSE round(1 - levenshtein(x.c, y.c) / greatest(length(x.c), length(y.c)), 6) END AS similarity FROM {_NAMES.replace('v(c)', 'x(c)')} JOIN {_NAMES.replace('v(c)', 'y(c)')} ON x.c < y.c")
def name_similarity(spark, sf_dir):
    return _name_pairs(spark).select("a", "b", N.similarity_column(F.col("a"), F.col("b")).alias("similarity"))


# ---- relationships


@query("relationships")
def relationships(spark, sf_dir):
    """Discovery over all fourteen tables, with evidence from whole tables."""
    found = D.discover_from_frames(frames(spark, sf_dir, TABLES)).dataframe(spark)
    return found.filter("via = ''").select("left_table", "left_columns", "right_table", "right_columns", "relationship_type", "join_type")


@query("fk_candidates_ranked")
def fk_candidates_ranked(spark, sf_dir):
    """Best parents of each foreign key, ties kept."""
    found = D.discover_from_frames(frames(spark, sf_dir, TABLES)).dataframe(spark).filter("via = ''")
    w = Window.partitionBy("left_table", "left_columns").orderBy(F.desc("confidence"))
    return found.select("left_table", "left_columns", "right_table", "right_columns", F.rank().over(w).alias("rnk")).filter("rnk = 1")


@query("cardinality", " UNION ALL ".join(f"SELECT '{a}.{ac}' AS child, '{b}.{bc}' AS parent, CASE WHEN c.m <= 1 AND p.m <= 1 THEN 'one_to_one' WHEN p.m <= 1 THEN 'many_to_one' WHEN c.m <= 1 THEN 'one_to_many' ELSE 'many_to_many' END AS relationship_type FROM (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM {a} GROUP BY {ac})) c, (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM {b} GROUP BY {bc})) p" for a, ac, b, bc in EDGES))
def cardinality(spark, sf_dir):
    kind = F.when((F.col("max_child") <= 1) & (F.col("max_parent") <= 1), "one_to_one").when(F.col("max_parent") <= 1, "many_to_one").when(F.col("max_child") <= 1, "one_to_many").otherwise("many_to_many")
    return _included(frames(spark, sf_dir, TABLES), EDGES).select("child", "parent", kind.alias("relationship_type"))


# ---- joins


def _order_customer(f):
    return f["orders"].select("o_orderkey", "o_custkey", "o_orderstatus"), f["customer"].select("c_custkey", "c_mktsegment")


for _how, _sql in (("inner", "JOIN"), ("left_outer", "LEFT JOIN"), ("right_outer", "RIGHT JOIN"), ("full_outer", "FULL JOIN")):

    @query(f"join_{_how}", f"SELECT c_mktsegment, o_orderstatus, count(o_orderkey) AS n_orders, count(c_custkey) AS n_customers FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') {_sql} (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey GROUP BY 1, 2")
    def _join(spark, sf_dir, how=_how):
        o, c = _order_customer(frames(spark, sf_dir))
        j = join_tables(o.filter("o_orderstatus <> 'P'"), c.filter("c_mktsegment <> 'BUILDING'"), [("o_custkey", "c_custkey")], how)
        return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("o_orderkey").alias("n_orders"), F.count("c_custkey").alias("n_customers"))


@query("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(spark, sf_dir):
    f = frames(spark, sf_dir)
    return join_tables(f["region"].select("r_name"), f["nation"].select("n_name"), [], "cross")


for _how, _sql in (("left_semi", "IN"), ("left_anti", "NOT IN")):

    @query(f"join_{_how}", f"SELECT lang, count(*) AS n FROM documents WHERE doc_id {_sql} (SELECT doc_id FROM labels) GROUP BY 1")
    def _semi(spark, sf_dir, how=_how):
        f = frames(spark, sf_dir, ["documents", "labels"])
        return f["documents"].join(f["labels"].select("doc_id"), "doc_id", how).groupBy("lang").agg(F.count("*").alias("n"))


@query("bridge_many_to_many", "SELECT p_brand, count(*) AS n_pairs, count(DISTINCT s_suppkey) AS n_suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def bridge_many_to_many(spark, sf_dir):
    f = frames(spark, sf_dir)
    pairs = bridge_join(f["part"], f["lineitem"], f["supplier"], ("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey"))
    return pairs.groupBy("p_brand").agg(F.count("*").alias("n_pairs"), F.count_distinct("s_suppkey").alias("n_suppliers"))


@query("self_reference_join", "WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT a.conv_id, a.turn, a.role, b.role AS parent_role, b.n AS parent_chars FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.turn - 1 = b.turn")
def self_reference_join(spark, sf_dir):
    """Each turn with the one before it."""
    c = frames(spark, sf_dir, ["conversations"])["conversations"].select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), (F.col("turn") - 1).alias("parent_turn"))
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.parent_turn") == F.col("b.turn")), "left").select("a.conv_id", "a.turn", "a.role", F.col("b.role").alias("parent_role"), F.col("b.n").alias("parent_chars"))


@query("documents_labels_join", "SELECT lang, quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def documents_labels_join(spark, sf_dir):
    f = frames(spark, sf_dir, ["documents", "labels"])
    return f["documents"].select("doc_id", "lang").join(f["labels"], "doc_id", "left").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


# ---- aggregates

for _agg, _sql in (("sum", "CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE)"), ("avg", "round(avg(CAST(o_totalprice AS DECIMAL(14,2))), 4)"), ("median", "median(o_totalprice)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("count", "count(o_totalprice)"), ("count_distinct", "count(DISTINCT o_custkey)")):

    @query(f"metric_{_agg}", f"SELECT o_orderpriority, {_sql} AS metric FROM orders GROUP BY 1")
    def _metric(spark, sf_dir, agg=_agg):
        from .functions.metrics import aggregation

        exact = "cast(o_totalprice as decimal(14,2))"
        e = {"sum": f"cast({aggregation('sum', exact)} as double)", "avg": f"cast(round({aggregation('avg', exact)}, 4) as double)"}.get(agg) or aggregation(agg, "o_custkey" if agg == "count_distinct" else "o_totalprice")
        return frames(spark, sf_dir)["orders"].groupBy("o_orderpriority").agg(F.expr(e).alias("metric"))


@query("metric_product", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(10,2)) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS metric FROM lineitem GROUP BY 1")
def metric_product(spark, sf_dir):
    from .functions.metrics import metric_expression, metric_intent

    e = metric_expression(metric_intent("quantity times price"), [("q", "DECIMAL"), ("p", "DECIMAL")])
    df = frames(spark, sf_dir)["lineitem"].select("l_returnflag", F.col("l_quantity").cast("decimal(10,2)").alias("q"), F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    return df.groupBy("l_returnflag").agg(F.expr(e).cast("double").alias("metric"))


# ---- filters


@query("named_filter_in", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def named_filter_in(spark, sf_dir):
    """The filter is suggested from the whole domain of the column."""
    orders = frames(spark, sf_dir)["orders"]
    raw = catalog.tables_from_frames({"orders": orders})[0]
    f = next(x for x in SF.suggest(raw, SF.small_domains(orders)) if x.name == "o_orderstatus_values")
    return orders.filter(f.expr).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("named_filter_last_30_days", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1")
def named_filter_last_30_days(spark, sf_dir):
    return SF.last_days(frames(spark, sf_dir)["orders"], "o_orderdate").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("events_last_window", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def events_last_window(spark, sf_dir):
    e = SF.last_days(frames(spark, sf_dir, ["events"])["events"], "ts", 7)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


# ---- logical SQL


def _views(spark, sf_dir):
    logical.register_views(spark, tpch_model(), frames(spark, sf_dir))


@query("logical_cte_query", "SELECT o_orderstatus, order_year, count(*) AS n FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders) GROUP BY 1, 2")
def logical_cte_query(spark, sf_dir):
    _views(spark, sf_dir)
    return spark.sql("SELECT o_orderstatus, order_year, count(*) AS n FROM __orders GROUP BY 1, 2")


@query("logical_cte_text", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def logical_cte_text(spark, sf_dir):
    """The same as text: a WITH for each logical table, put in, taken out and put in again."""
    model = tpch_model()
    for n, df in frames(spark, sf_dir).items():
        df.createOrReplaceTempView(n)
    sql = "SELECT c_mktsegment, count(*) AS n FROM __orders JOIN __customer ON o_custkey = c_custkey GROUP BY 1"
    whole = logical.expand_logical_tables(spark, sql, model)
    return spark.sql(logical.expand_logical_tables(spark, logical.remove_logical_tables(whole, [t.name for t in model.tables]), model))


@query("window_passthrough", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth_order, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS customer_total FROM orders")
def window_passthrough(spark, sf_dir):
    """Window expressions as logical columns."""
    t = Table("o", BaseTable("", "", "orders"), columns=[Column("o_orderkey", "o_orderkey"), Column("o_custkey", "o_custkey"), Column("nth_order", "cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint)"), Column("customer_total", "cast(sum(cast(o_totalprice as decimal(14,2))) over (partition by o_custkey) as double)")])
    return logical.view(spark, t, frames(spark, sf_dir)["orders"])


_MIXED = Table("o", BaseTable("", "", "orders"), columns=[Column("status", "o_orderstatus"), Column("n_orders", "count(o_orderkey)"), Column("first_order", "min(o_orderkey)"), Column("double_key", "o_orderkey * 2")])


@query("agg_select", "SELECT count(o_orderkey) AS n_orders, min(o_orderkey) AS first_order FROM orders")
def agg_select(spark, sf_dir):
    frames(spark, sf_dir)["orders"].createOrReplaceTempView("orders")
    return spark.sql(logical.generated_selects(spark, _MIXED, 10)[0])


@query("non_agg_select", "SELECT o_orderstatus AS status, o_orderkey * 2 AS double_key FROM orders")
def non_agg_select(spark, sf_dir):
    """The projection without aggregates, over the whole table."""
    frames(spark, sf_dir)["orders"].createOrReplaceTempView("orders")
    rows, _ = logical.split_aggregates(spark, _MIXED)
    return spark.table("orders").selectExpr(*[logical.projection(c) for c in rows])


@query("verified_query_top_suppliers", "SELECT s_name, CAST(sum(CAST(l_quantity AS DECIMAL(10,2))) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY quantity DESC, s_name LIMIT 10")
def verified_query_top_suppliers(spark, sf_dir):
    """A top-k report over logical tables."""
    _views(spark, sf_dir)
    return spark.sql("SELECT s_name, cast(sum(cast(quantity as decimal(10,2))) as double) AS quantity FROM __lineitem JOIN __supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY quantity DESC, s_name LIMIT 10")


@query("verified_query_region_nation", "SELECT r_name, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def verified_query_region_nation(spark, sf_dir):
    return planner(spark, sf_dir).run(SemanticQuery(["customer.n_customers"], ["region.r_name", "nation.n_name"]))


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf_dir):
    """An extension: all grouping sets of two dimensions."""
    return frames(spark, sf_dir)["lineitem"].cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# ---- partner, fingerprint, stream

DBT = [{"name": "orders", "entities": [{"name": "order", "expr": "o_orderkey"}], "dimensions": [{"name": "status", "expr": "o_orderstatus", "type": "categorical"}, {"name": "ordered_at", "expr": "o_orderdate", "type": "time"}], "measures": [{"name": "spend", "expr": "o_totalprice", "agg": "sum"}, {"name": "tax_paid", "agg": "sum"}]}]


@query("partner_merge")
def partner_merge(spark, sf_dir):
    merged = partner.merge(partner.model_rows(spark, tpch_model().table("orders")), partner.dbt_rows(spark, DBT))
    return merged.select("field_key", "section", "data_type", "name", "expr", "origin")


@query("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    parts = [fingerprint(df).select(F.lit(n).alias("table_name"), "*") for n, df in frames(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


@query("windowed_profile", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, count(value) AS non_null, min(value) AS value_min, max(value) AS value_max, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    """The streaming profile's plan over the whole table as a batch."""
    return windowed_profile(frames(spark, sf_dir, ["events"])["events"], "ts", "event_type", "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("generated_model")
def generated_model(spark, sf_dir):
    """Fields of the model generated from the seven relational tables."""
    from .plans.build import build_model

    model = build_model(spark, frames(spark, sf_dir), "trade")
    rows = [(t.name, c.name, section, c.expr, c.data_type) for t in model.tables for section in ("dimensions", "time_dimensions", "facts") for c in getattr(t, section)]
    return spark.createDataFrame(rows, "table_name string, column_name string, section string, expr string, data_type string")


from . import rows as _rows  # noqa: E402, F401  (registers its queries)
