"""Column statistics: one aggregation a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = "column_name string, row_count long, ndv long, non_null long, min_value string, max_value string"


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]


def as_text(df: DataFrame, c: str) -> Column:
    """Values as text that other engines print alike."""
    t = df.schema[c].dataType
    if isinstance(t, T.DoubleType | T.FloatType):
        plain = F.abs(F.col(c)) < 1e31  # false of NaN
        return F.when(plain, F.when(plain, F.col(c)).cast("decimal(38,6)").cast("string")).otherwise(F.col(c).cast("string"))
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.col(c).cast("string")


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """One row a column.  ``fraction`` samples rows.

    ``exact=False`` counts distinct values by sketches: one pass for all columns, without a shuffle of values.  Exact
    counts are one narrow aggregation for each column, which reads that column alone; all of
    them in one aggregation would expand every row by the number of columns.
    """
    cols = plain_columns(df) if columns is None else columns
    if not cols:
        return df.sparkSession.createDataFrame([], PROFILE)
    df = df.select(cols)
    if fraction is not None:
        df = df.sample(fraction=fraction, seed=seed)
    if exact:
        return reduce(DataFrame.unionByName, [_one(df, [c], F.count_distinct) for c in cols])
    return _one(df, cols, F.approx_count_distinct)


def _one(df: DataFrame, cols: list[str], distinct) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [distinct(F.col(c)).alias(f"d{i}"), F.count(c).alias(f"c{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"d{i}").alias("ndv"), F.col(f"c{i}").alias("non_null"), as_text(wide, f"lo{i}").alias("min_value"), as_text(wide, f"hi{i}").alias("max_value"))
                for i, c in enumerate(cols)
            ]
        )
    ).alias("r")
    return wide.select(rows).select("r.*")


def profile_tables(frames: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = profile(df, exact=exact).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def uniqueness(profiled: DataFrame) -> DataFrame:
    """Adds ``uniqueness`` = distinct / non-null values (null without values) and ``key_like``."""
    u = F.try_divide(F.col("ndv"), F.col("non_null"))
    return profiled.withColumn("uniqueness", F.round(F.least(u, F.lit(1.0)), 6)).withColumn("key_like", (F.col("ndv") >= 2) & (F.coalesce(u, F.lit(0.0)) >= 0.9))


def nullish(c: Column, kind: T.DataType) -> Column:
    from ..functions.rules import NULLISH

    out = c.isNull()
    if isinstance(kind, T.DoubleType | T.FloatType):
        return out | F.isnan(c)
    if isinstance(kind, T.StringType):
        return out | F.upper(F.trim(c)).isin(*NULLISH)
    return out


def null_probe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, has_null, null_ratio, nullish_ratio) in one scan."""
    cols = columns or plain_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"a{i}"), F.count_if(nullish(F.col(c), df.schema[c].dataType)).alias(f"b{i}")]
    wide = df.agg(*aggs)
    ratio = lambda x: F.round(F.coalesce(F.try_divide(F.col(x), F.col("n")), F.lit(0.0)), 6)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(f"a{i}") > 0).alias("has_null"), ratio(f"a{i}").alias("null_ratio"), ratio(f"b{i}").alias("nullish_ratio")) for i, c in enumerate(cols)])).alias("r")).select("r.*")


def frequency_skew(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, max_freq, min_freq, skew): of the values of each column."""
    freq = [df.select(F.col(c).alias("value")).filter("value is not null").groupBy("value").count().agg(F.max("count").alias("max_freq"), F.min("count").alias("min_freq")).select(F.lit(c).alias("column_name"), "*") for c in columns]
    return reduce(DataFrame.unionByName, freq).filter("max_freq is not null").withColumn("skew", F.round(F.col("max_freq") / F.col("min_freq"), 6))


def affix_consistency(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """(affix, share): the most frequent prefix or suffix of one to n characters of the values; ties to the longest, then in order."""
    v = df.select(F.col(column).cast("string").alias("v")).filter("v is not null and v <> ''")
    cuts = F.array(*[x for k in range(1, n + 1) for x in (F.struct(F.lit("prefix").alias("side"), F.left("v", F.lit(k)).alias("affix")), F.struct(F.lit("suffix").alias("side"), F.right("v", F.lit(k)).alias("affix")))])
    total = v.agg(F.count("*").alias("total"))
    return (
        v.select(F.explode(cuts).alias("a")).groupBy("a.side", "a.affix").count().crossJoin(F.broadcast(total))  # one row
        .select("side", "affix", F.round(F.col("count") / F.col("total"), 6).alias("share")).orderBy(F.desc("share"), F.desc(F.length("affix")), "side", "affix").limit(1)
    )


@dataclass(frozen=True)
class Thresholds:
    min_sample_size: int
    uniqueness: float
    similarity: float


def adaptive_thresholds(uniqueness: list[float], skews: list[float], sizes: list[int], n_tables: int) -> Thresholds:
    """Stricter with skewed values and small samples, laxer with mostly unique ones; the defaults without samples."""
    if not sizes:
        return Thresholds(50, 0.95, 0.6)
    mean = lambda x: sum(x) / len(x) if x else 0.0
    u, skew, size = mean(uniqueness), mean(skews), mean(sizes)
    n = 50.0
    n *= 0.6 if u > 0.9 else 0.8 if u > 0.7 else 1.0
    n *= 1.5 if skew > 10 else 1.2 if skew > 5 else 1.0
    n *= 1.3 if n_tables > 10 else 1.1 if n_tables > 5 else 1.0
    n *= min(max(max(sizes) / 50, 1.0), 3.0)
    unique = 0.95 * (1.02 if skew > 10 else 1.01 if skew > 5 else 1.0) * (1.02 if size < 20 else 1.0)
    similar = 0.6 * (0.9 if u > 0.9 else 0.95 if u > 0.7 else 1.0)
    return Thresholds(max(10, round(n)), min(0.99, unique), max(0.4, similar))
