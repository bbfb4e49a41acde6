"""Quality rules with adaptive thresholds.

Every document gets a few integer features: shares of symbols and upper case letters, of repeated trigrams of words
and of words that come doubled, and the mean length of words.  Their distribution per language and
source is kept in mergeable quantile sketches: log-linear histograms with 32
buckets an octave (exact below 64, within 1/32 above), whose merge is the sum of the
counts of equal buckets, so that results don't depend on order or partitions.
Instead of fixed cutoffs, each group's fences are ``q75 + reach * spread`` and, for
word length, ``q25 - reach * spread``, with ``spread = max(q75 - q25, floor)``.
Documents are joined with the fences of their group and filtered.

Defined results.  A null, empty or blank text has no words and is rejected.  A null
``lang`` or ``source`` counts as the empty string.  A group of fewer than
``min_group`` documents uses the fences of its language, and a language of fewer
those of all documents (the sketches are merged for it).  Texts count whole, however long.  Ties don't arise.  Repeated rows count, and are
kept or rejected, one by one.  Null ``doc_id`` is carried along.  Extra columns are
kept by ``filter_documents`` under any name and ignored by ``quality_report``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, let, materialize, own_columns, own_name, table

REACH = 3
MIN_GROUP = 100
#: feature -> (least spread, has a lower fence)
FEATURES = {"symbol_pm": (20, False), "upper_pm": (60, False), "repeat_pm": (135, False), "twice_pm": (45, False), "word_len10": (12, True)}
SPACE = "[ \\t\\n\\r\\f]+"


def features(text: Column) -> Column:
    """Struct of n_words and the features; per mille, or tenths of a character.  Every pass over the text is made once."""
    flat = F.trim(F.regexp_replace(text, SPACE, " "))
    symbols = F.length(F.regexp_replace(text, "[\\p{L}\\p{N} \\t\\n\\r\\f.,;:'\"()?-]+", ""))
    upper = F.length(F.regexp_replace(text, "\\P{Lu}+", ""))
    scanned = let(flat, lambda t: F.struct(F.split(t, " ").alias("w"), F.length(t).alias("length"), symbols.alias("symbols"), upper.alias("upper")))

    def of_words(s: Column) -> Column:
        w, n = s["w"], F.size(s["w"])
        grams = F.transform(
            F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
        )
        repeats = F.when(n >= 3, n - 2 - F.size(F.array_distinct(grams))).otherwise(0)
        twice = F.when(n >= 2, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(w, i) == F.element_at(w, i + 1)))).otherwise(0)
        return F.struct(n.alias("n"), (s["length"] - n + 1).alias("chars"), s["symbols"], s["upper"], repeats.alias("repeats"), twice.alias("twice"))

    def finish(s: Column) -> Column:
        pm = lambda part, whole: F.floor(F.lit(1000) * part / F.greatest(whole, F.lit(1))).cast("int")
        return F.struct(
            F.when(s["chars"] > 0, s["n"]).otherwise(0).alias("n_words"),
            pm(s["symbols"], s["chars"]).alias("symbol_pm"),
            pm(s["upper"], s["chars"]).alias("upper_pm"),
            pm(s["repeats"], s["n"] - 2).alias("repeat_pm"),
            pm(s["twice"], s["n"] - 1).alias("twice_pm"),
            F.floor(F.lit(10) * s["chars"] / s["n"]).cast("int").alias("word_len10"),
        )

    return let(let(scanned, of_words), finish)


def bucket_of(v: Column) -> Column:
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v.cast("long")).otherwise(shift * 32 + F.call_function("shiftright", v.cast("long"), shift)).cast("int")


def top_of(b: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b.cast("long")).otherwise(F.call_function("shiftleft", (b % 32 + 33).cast("long"), shift) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) from rows with lang, source and the features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bucket_of(F.col(f)).alias("bucket")) for f in FEATURES]))
    return (
        rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_words", pairs.alias("p"))
        .groupBy("lang", "source", "p.feature", "p.bucket")
        .agg(F.count_if(F.col("n_words") > 0).alias("n"))  # a filter on n_words would be pushed below and compute the features again
        .filter("n > 0")
    )


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "feature")
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    run = merged.select(
        "*", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total")
    )
    at = lambda pct: F.min(F.when(F.col("upto") * 100 >= F.col("total") * pct, F.col("bucket")))
    q = run.groupBy(*keys, "feature").agg(F.max("total").alias("total"), top_of(at(25)).alias("q25"), top_of(at(75)).alias("q75"))
    cases = []
    for f, (floor, low) in FEATURES.items():
        here = F.col("feature") == f
        spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(floor)) * REACH
        cases.append(F.max(F.when(here, F.col("q75") + spread)).alias(f"{f}_hi"))
        if low:
            cases.append(F.max(F.when(here, F.col("q25") - spread)).alias(f"{f}_lo"))
    return q.groupBy(*keys).agg(F.max("total").alias("n_group"), *cases)


FENCES = [f"{f}_{end}" for f, (_, low) in FEATURES.items() for end in (["hi", "lo"] if low else ["hi"])]


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with its fences.  ``sketch`` should be materialized: it is read three times."""
    own, lang, whole = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    pick = [
        F.when(F.col("o.n_group") >= min_group, F.col(f"o.{c}")).when(F.col("l.n_group") >= min_group, F.col(f"l.{c}")).otherwise(F.col(f"w.{c}")).alias(c)
        for c in FENCES
    ]
    return own.alias("o").join(lang.alias("l"), "lang").crossJoin(whole.alias("w")).select(F.col("lang"), F.col("o.source").alias("source"), *pick)


def passes(f, t) -> Column:
    """f, t: functions from a name to the feature's and the fence's column."""
    ok = f("n_words") > 0
    for name, (_, low) in FEATURES.items():
        ok &= f(name) <= t(f"{name}_hi")
        if low:
            ok &= f(name) >= t(f"{name}_lo")
    return ok


def quality_report(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents kept: doc_id, lang, source, features and the fences they were held against.

    Reads the texts once; the features (no text) are kept in the shared folder.
    """
    feats = materialize(docs.select("doc_id", "lang", "source", features(F.col("text")).alias("f")).select("doc_id", "lang", "source", "f.*"), "features")
    sketch = materialize(sketches(feats), "sketch")
    fences = materialize(thresholds(sketch, min_group), "fences").select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), *FENCES)
    drop(docs.sparkSession, sketch)
    joined = feats.join(fences, (F.coalesce("lang", F.lit("")) == F.col("k_lang")) & (F.coalesce("source", F.lit("")) == F.col("k_source")))
    return joined.filter(passes(F.col, F.col)).drop("k_lang", "k_source")


def filter_documents(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents kept, with all their columns.  The rows are written once with their features, which are computed once."""
    own = {c: own_name(docs, c) for c in ("features", "lang", "source", *FENCES)}
    rows = materialize(docs.select(*own_columns(docs), features(F.col("text")).alias(own["features"])), "featured")
    sketch = materialize(sketches(rows.select("lang", "source", f"{own['features']}.*")), "sketch")
    fences = materialize(thresholds(sketch, min_group), "fences")
    drop(docs.sparkSession, sketch)
    fences = fences.select(*[F.col(c).alias(own[c]) for c in fences.columns])
    same = (F.coalesce("lang", F.lit("")) == F.col(own["lang"])) & (F.coalesce("source", F.lit("")) == F.col(own["source"]))
    ok = passes(lambda n: F.col(own["features"])[n], lambda n: F.col(own[n]))
    return rows.join(fences, same).filter(ok).select(own_columns(docs))


#: The features and fences in DuckDB's SQL; {docs} is a table, {then} what is selected from feats f and fences.
def duckdb_sql(docs: str, then: str, min_group: int = MIN_GROUP) -> str:
    long = " UNION ALL ".join(
        f"SELECT lang, source, '{f}' AS feature, CASE WHEN {f} < 64 THEN {f} ELSE (length(bin({f})) - 6) * 32 + ({f} >> (length(bin({f})) - 6)) END AS bucket FROM feats WHERE n_words > 0" for f in FEATURES
    )
    floors = "CASE feature " + " ".join(f"WHEN '{f}' THEN {fl}" for f, (fl, _) in FEATURES.items()) + " END"
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        by = "".join(f"{k}, " for k in keys)
        levels.append(
            f"r{level} AS (SELECT {by}feature, bucket, sum(n) OVER (PARTITION BY {by}feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}feature) AS total"
            f" FROM (SELECT {by}feature, bucket, sum(n) AS n FROM sk GROUP BY {by}feature, bucket)),"
            f" p{level} AS (SELECT {by}feature, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS b25, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS b75 FROM r{level} GROUP BY {by}feature),"
            f" q{level} AS (SELECT {by}feature, total, CASE WHEN b25 < 64 THEN b25 ELSE ((b25 % 32 + 33) << (b25 // 32 - 1)) - 1 END AS q25, CASE WHEN b75 < 64 THEN b75 ELSE ((b75 % 32 + 33) << (b75 // 32 - 1)) - 1 END AS q75 FROM p{level}),"
            f" t{level} AS (SELECT {by}max(total) AS n_group, "
            + ", ".join(
                f"max(CASE WHEN feature = '{c[:-3]}' THEN " + (f"q75 + {REACH} * greatest(q75 - q25, {floors})" if c.endswith("hi") else f"q25 - {REACH} * greatest(q75 - q25, {floors})") + f" END) AS {c}" for c in FENCES
            )
            + f" FROM q{level}{' GROUP BY ' + ', '.join(keys) if keys else ''})"
        )
    pick = ", ".join(
        f"CASE WHEN t0.n_group >= {min_group} THEN t0.{c} WHEN t1.n_group >= {min_group} THEN t1.{c} ELSE t2.{c} END AS {c}" for c in FENCES
    )
    ok = "n_words > 0 AND " + " AND ".join(f"{c[:-3]} {'<=' if c.endswith('hi') else '>='} {c}" for c in FENCES)
    return f"""
WITH parts AS (SELECT *, length(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g')) AS chars,
    length(regexp_replace(text, '[\\p{{L}}\\p{{N}} \\t\\n\\r\\f.,;:''"()?-]+', '', 'g')) AS symbols,
    length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS uppers,
    string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ') AS w FROM {docs}),
counted AS (SELECT *, len(w) AS nw, CASE WHEN len(w) >= 3 THEN len(w) - 2 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) ELSE 0 END AS repeats, len(list_filter(range(1, len(w)), lambda i : w[i] = w[i + 1])) AS twice FROM parts),
feats AS (SELECT * EXCLUDE (lang, source), coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
    CAST(CASE WHEN chars > 0 THEN nw ELSE 0 END AS INTEGER) AS n_words, CAST(1000 * symbols // greatest(chars, 1) AS INTEGER) AS symbol_pm,
    CAST(1000 * uppers // greatest(chars, 1) AS INTEGER) AS upper_pm, CAST(1000 * repeats // greatest(nw - 2, 1) AS INTEGER) AS repeat_pm, CAST(1000 * twice // greatest(nw - 1, 1) AS INTEGER) AS twice_pm,
    CAST(10 * chars // nw AS INTEGER) AS word_len10 FROM counted),
sk AS (SELECT lang, source, feature, bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
{', '.join(levels)},
fences AS (SELECT t0.lang, t0.source, {pick} FROM t0 JOIN t1 USING (lang) CROSS JOIN t2),
kept AS (SELECT f.*, {', '.join(f'CAST(fences.{c} AS BIGINT) AS {c}' for c in FENCES)} FROM feats f JOIN fences USING (lang, source) WHERE {ok})
{then}"""


ORACLE = duckdb_sql(
    "documents", "SELECT doc_id, lang0 AS lang, source0 AS source, n_words, " + ", ".join(FEATURES) + ", " + ", ".join(FENCES) + " FROM kept"
)


def op1_quality_rules(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))
