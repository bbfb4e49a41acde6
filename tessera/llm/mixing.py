"""Mixing sources to target weights over a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a piecewise linear weight schedule
``w(t)``; at every knot the weights of all sources sum to one.  Of ``T`` training tokens
the source has been asked for ``D(t) = T * integral of w from 0 to t`` by time t.  Its documents,
in an order shuffled by the hash of doc_id, lie end to end; the one that begins at
token ``c`` is due at the time t with ``D(t) = c``, a quadratic in each stretch, and gets
the training position ``floor(T * t)``.  When a source is used up it begins again
(``epoch`` 1, 2, ...), and what exceeds its whole demand isn't used.

The default schedule holds the natural shares of tokens until a quarter of the time,
and then moves linearly to shares in proportion to the square root of a source's
tokens.  The default ``T`` is the least for which every document is used at least once.

A document's tokens are its UTF-8 bytes and one separator.  Prefix sums go over 65,536 hash
buckets a source and then within each bucket, so a hot source is spread over many
tasks.  Sorting by position is a range sort whose ranges need no sample: as the weights sum to one, equal ranges of
positions hold equal numbers of tokens.

Defined results.  A null or empty text is one token, the separator.  A null source is the
empty source.  Null doc_ids come first in their source.  Rows of equal doc_id are ordered by
size; equal rows are interchangeable.  Texts of any length count whole; a document of an empty schedule isn't used.  Ties in position are ordered by source,
doc_id and epoch.  Sources without a schedule, when one is given, are not used.  Extra
columns are kept by ``mix_documents`` under any name and ignored by ``positions``.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns, own_name, table

HOLD = 0.25
#: Tokens of a range of positions, at most, and so of a partition of the result.
RANGE_TOKENS = 512 << 20
#: Of the hash, for the buckets: 65,536 a source.  The order within a source doesn't depend on it.
HEX_DIGITS = 4


def default_knots(totals: DataFrame) -> DataFrame:
    """(source, t, w) from (source, supply)."""
    root = F.floor(F.sqrt(F.col("supply").cast("double")) * 1000).cast("long")
    every = totals.select("source", "supply", root.alias("r")).crossJoin(totals.select(root.alias("r"), "supply").agg(F.sum("supply").alias("all_supply"), F.sum("r").alias("all_r")))
    natural = F.col("supply").cast("double") / F.col("all_supply").cast("double")
    flat = F.col("r").cast("double") / F.col("all_r").cast("double")
    steps = F.array(*[F.struct(F.lit(t).alias("t"), w.alias("w")) for t, w in ((0.0, natural), (HOLD, natural), (1.0, flat))])
    return every.select("source", F.explode(steps).alias("k")).select("source", "k.t", "k.w")


def stretches(knots: DataFrame) -> DataFrame:
    """(source, parts, share): the stretches between knots with the integral before each, and the whole integral."""
    w = Window.partitionBy("source").orderBy("t")
    pairs = knots.select("source", F.col("t").alias("t0"), F.col("w").alias("w0"), F.lead("t").over(w).alias("t1"), F.lead("w").over(w).alias("w1")).filter("t1 > t0")
    area = F.expr("(t1 - t0) * (w0 + w1) / 2")
    upto = pairs.select("*", F.coalesce(F.sum(area).over(w0_order()), F.lit(0.0)).alias("c0"), area.alias("area"))
    return upto.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("c0", "t0", "t1", "w0", "w1"))).alias("parts"), F.max(F.col("c0") + F.col("area")).alias("share"))


def w0_order():
    return Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)


def due(parts: Column, d: Column) -> Column:
    """The time t with integral d."""
    part = F.element_at(F.filter(parts, lambda s: s["c0"] <= d), -1)

    def solve(s: Column) -> Column:
        x = d - s["c0"]
        slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
        root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * x, F.lit(0.0)))
        return F.when(x <= 0, s["t0"]).otherwise(F.least(s["t1"], s["t0"] + 2 * x / (s["w0"] + root)))

    return F.transform(F.array(part), solve)[0]


def _assigned(docs: DataFrame, tokens: Column, knots: DataFrame | None, total: int | None) -> tuple[DataFrame, dict[str, str], int]:
    """(docs with columns of ours: position, epoch, tokens; their names; the number of training tokens)."""
    name = {k: own_name(docs, k) for k in ("h", "bucket", "source", "tokens", "begin", "supply", "parts", "share", "all", "epoch", "position", "upto", "first")}
    h = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = docs.withColumns({name["h"]: h, name["source"]: F.coalesce("source", F.lit("")), name["tokens"]: tokens})
    # null ids, which come first, in the order of their sizes: they have buckets by size
    rows = rows.withColumn(name["bucket"], F.when(F.col(name["h"]) == "", F.concat(F.lit(" "), F.lpad(F.col(name["tokens"]).cast("string"), 20, "0"))).otherwise(F.substring(name["h"], 1, HEX_DIGITS)))
    buckets = materialize(
        rows.groupBy(F.col(name["source"]).alias("source"), F.col(name["bucket"]).alias("bucket")).agg(F.sum(name["tokens"]).alias("tokens")), "buckets"
    )
    totals = buckets.groupBy("source").agg(F.sum("tokens").alias("supply"))
    per = stretches(default_knots(totals) if knots is None else knots).join(totals, "source").filter("share > 0")
    whole = F.lit(total).cast("long") if total is not None else F.ceil(F.max(F.col("supply").cast("double") / F.col("share"))).cast("long")
    per = materialize(per.crossJoin(per.agg(whole.alias("all"))), "schedule")
    demanded = (per.select("all").first() or (0,))[0]
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select(F.col("source").alias(name["source"] + "_o"), F.col("bucket").alias(name["bucket"] + "_o"), before.alias(name["upto"] + "_o"))
    per = per.select(F.col("source").alias(name["source"] + "_p"), *[F.col(c).alias(name[c] + "_o") for c in ("supply", "parts", "share", "all")])
    local = F.sum(name["tokens"]).over(Window.partitionBy(name["source"], name["bucket"]).orderBy(name["h"], "doc_id", name["tokens"]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn(name["begin"], local - F.col(name["tokens"]))
    rows = rows.join(offsets, (F.col(name["source"]) == F.col(name["source"] + "_o")) & (F.col(name["bucket"]) == F.col(name["bucket"] + "_o")))
    rows = rows.join(per, F.col(name["source"]) == F.col(name["source"] + "_p"))
    o = lambda c: F.col(name[c] + "_o")
    rows = rows.withColumn(name["first"], F.col(name["begin"]) + o("upto"))
    first = F.col(name["first"])
    demand = o("all").cast("double") * o("share")
    last = F.floor((demand - first.cast("double")) / o("supply").cast("double"))
    exact = first.cast("double") + last.cast("double") * o("supply").cast("double") >= demand  # due at the very end: not used
    rows = rows.withColumn(name["epoch"], F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda e: (last >= 0) & ((e < last) | ~exact))))
    c = (first + F.col(name["epoch"]) * o("supply")).cast("double") / o("all").cast("double")
    rows = rows.withColumn(name["position"], F.floor(o("all").cast("double") * due(o("parts"), c)).cast("long"))
    return rows, name, demanded


def _tokens() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _sorted(rows: DataFrame, name: dict[str, str], demanded: int) -> DataFrame:
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-demanded // RANGE_TOKENS))
    keys = [F.col(name["position"]), F.col(name["source"]), F.col("doc_id"), F.col(name["epoch"])]
    at = F.least(F.lit(ranges - 1), F.floor(F.col(name["position"]).cast("double") * ranges / max(demanded, 1))).cast("int")
    return rows.repartitionById(ranges, at).sortWithinPartitions(*keys)


def positions(docs: DataFrame, knots: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, epoch, position) in the order of position; knots: (source, t, w)."""
    slim = docs.select("doc_id", "source", _tokens().alias("n"))
    rows, name, demanded = _assigned(slim, F.col("n"), knots, total)
    return _sorted(rows, name, demanded).select("doc_id", "source", F.col("n").alias("tokens"), F.col(name["epoch"]).alias("epoch"), F.col(name["position"]).alias("position"))


def mix_documents(docs: DataFrame, knots: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """The documents in training order, with all their columns; a document comes once for each epoch."""
    rows, name, demanded = _assigned(docs, _tokens(), knots, total)
    return _sorted(rows, name, demanded).select(own_columns(docs))


def op7_source_mixing(spark, sf_dir):
    return positions(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source AS source0, coalesce(source, '') AS source, coalesce(strlen(text), 0) + 1 AS tokens, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(floor(sqrt(CAST(sum(tokens) AS DOUBLE)) * 1000) AS BIGINT) AS r FROM d GROUP BY source),
w AS (SELECT source, supply, CAST(supply AS DOUBLE) / CAST((SELECT sum(supply) FROM s) AS DOUBLE) AS p, CAST(r AS DOUBLE) / CAST((SELECT sum(r) FROM s) AS DOUBLE) AS q FROM s),
a AS (SELECT *, ({HOLD} - 0.0::DOUBLE) * (p + p) / 2 AS c1 FROM w),
b AS (SELECT *, c1 + (1.0::DOUBLE - {HOLD}::DOUBLE) * (p + q) / 2 AS share FROM a),
t AS (SELECT *, (SELECT CAST(ceil(max(CAST(supply AS DOUBLE) / share)) AS BIGINT) FROM b) AS total FROM b),
x AS (SELECT d.*, t.* EXCLUDE (source), sum(tokens) OVER (PARTITION BY d.source ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS begin FROM d JOIN t ON d.source = t.source),
e AS (SELECT *, unnest(range(CAST(0 AS BIGINT), CAST(ceil(CAST(total AS DOUBLE) * share / supply) AS BIGINT) + 1)) AS epoch FROM x),
f AS (SELECT *, CAST(begin + epoch * supply AS DOUBLE) AS due FROM e WHERE CAST(begin AS DOUBLE) + CAST(epoch AS DOUBLE) * supply < CAST(total AS DOUBLE) * share),
g AS (SELECT *, due / CAST(total AS DOUBLE) AS y FROM f)
SELECT doc_id, source0 AS source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS BIGINT) AS epoch,
  CAST(floor(CAST(total AS DOUBLE) * CASE WHEN y < c1 THEN CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE least({HOLD}::DOUBLE, 0.0::DOUBLE + 2 * y / (p + sqrt(p * p))) END
    WHEN y - c1 <= 0 THEN {HOLD}::DOUBLE
    ELSE least(1.0::DOUBLE, {HOLD}::DOUBLE + 2 * (y - c1) / (p + sqrt(greatest(p * p + 2 * ((q - p) / (1.0::DOUBLE - {HOLD}::DOUBLE)) * (y - c1), 0.0::DOUBLE)))) END) AS BIGINT) AS position
FROM g"""
