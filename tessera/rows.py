"""Queries over names, types, models and plans, as result tables, and the SQL that computes the same from DuckDB's information schema.

The SQL is an independent statement of the rules in lists and regular expressions; it shares only the rule tables' words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import metrics as MT
from .functions import names as N
from .functions import rules as R
from .operators import confidence as C
from .operators import discover as D
from .operators import inclusion as I
from .operators import profile as P
from .plans import enrich, logical, parse, validate
from .plans import model as M
from .plans.model import BaseTable, Column, Metric, NamedFilter, RelationKey, Relationship, SemanticModel, Table, VerifiedQuery
from .plans.query import Planner, SemanticQuery, run_verified_queries
from .queries import DBT, KEY_COLUMNS, ORACLES, RELATIONAL, TABLES, frames, query, tpch_model
from .sources import catalog

# ---- SQL of the name algebra: functions from SQL text to SQL text


def text_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def tokens(c: str) -> str:
    return f"string_split(upper({c}), '_')"


def bare_tokens(c: str) -> str:
    """Without a first token of one or two letters."""
    t = tokens(c)
    return f"(CASE WHEN len({t}) > 1 AND length({t}[1]) <= 2 AND {t}[1] <> 'ID' THEN {t}[2:] ELSE {t} END)"


def suffix(c: str) -> str:
    last = f"list_last({bare_tokens(c)})"
    cases = " ".join(f"WHEN regexp_matches({last}, '.{s}$') THEN '{s}'" for s in ("KEY", "ID", "NUMBER", "NUM"))
    return f"(CASE WHEN list_contains({text_list(R.KEY_SUFFIXES)}, {last}) THEN {last} {cases} ELSE '' END)"


def stem(c: str) -> str:
    b = bare_tokens(c)
    last, rest = f"list_last({b})", f"{b}[1:len({b}) - 1]"
    cases = " ".join(f"WHEN regexp_matches({last}, '.{s}$') THEN array_to_string(list_append({rest}, left({last}, length({last}) - {len(s)})), '_')" for s in ("KEY", "ID", "NUMBER", "NUM"))
    return f"(CASE WHEN list_contains({text_list(R.KEY_SUFFIXES)}, {last}) THEN array_to_string({rest}, '_') {cases} ELSE array_to_string({b}, '_') END)"


def singular(t: str) -> str:
    return (
        f"(CASE WHEN {t} LIKE '%IES' AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'Y' WHEN regexp_matches({t}, '(SS|X|Z|[CS]H)ES$') THEN left({t}, length({t}) - 2)"
        f" WHEN {t} LIKE '%S' AND NOT regexp_matches({t}, '(SS|US|IS)$') AND length({t}) > 3 THEN left({t}, length({t}) - 1) ELSE {t} END)"
    )


def expanded(t: str) -> str:
    return f"coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in sorted(R.ABBREVIATIONS.items()))}}}[{t}], {t})"


def variants(a: str, b: str) -> str:
    """a, b: columns with words that are singular already."""
    short, long = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    x, y = expanded(a), expanded(b)
    near = f"1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) > 0.85"
    return f"({a} <> '' AND {b} <> '' AND ({x} = {y} OR (length({short}) >= 3 AND starts_with({long}, {short}) AND NOT contains({long}, '_')) OR {near}))"


def any_of(c: str, words) -> str:
    return f"list_has_any({tokens(c)}, {text_list(words)})"


FAMILY = "CASE WHEN data_type LIKE '%[]' THEN 'object' WHEN data_type = 'VARCHAR' THEN 'categorical' WHEN data_type LIKE 'TIMESTAMP%' THEN 'time' ELSE 'numeric' END"
KEY_FAMILY = "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN data_type = 'VARCHAR' THEN 'string' END"
SPARK_TYPE = "CASE data_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END"
#: All columns of all tables with what the rules say about their names.
COLS = f"""cols AS (SELECT table_name AS t, column_name AS c, data_type, CAST(ordinal_position AS INTEGER) AS ordinal, {FAMILY} AS family, {KEY_FAMILY} AS key_family,
  {stem('column_name')} AS stem, {suffix('column_name')} AS suffix, {singular('upper(table_name)')} AS entity FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)}))"""
IDENTIFIER_LIKE = f"(suffix <> '' OR list_last({tokens('c')}) = 'REFERENCE')"
EXCLUDED = f"""(CASE WHEN family IN ('time', 'object') OR key_family IS NULL THEN true WHEN {any_of('c', 'ID KEY UUID GUID CODE NO'.split())} OR suffix IN ('KEY', 'ID') THEN false
  WHEN {any_of('c', R.SYSTEM_ACTIONS)} AND {any_of('c', 'AT ON TIME'.split())} THEN true ELSE {any_of('c', R.CONTENT_WORDS | R.MEASURE_WORDS)} OR ({any_of('c', R.TIME_WORDS)} AND key_family <> 'integer') END)"""
ENTITY_MATCH = f"(stem <> '' AND suffix <> '' AND (stem = entity OR {variants('stem', 'entity')}))"
LOOKS_LIKE_PK = f"(upper(c) IN ('ID', 'PK', 'KEY', 'ROWID', 'UUID', 'GUID', {', '.join(f"'{s}'" for s in sorted(R.SURROGATES))}) OR {ENTITY_MATCH})"
COLS2 = f"named AS (SELECT *, {IDENTIFIER_LIKE} AS identifier_like, {EXCLUDED} AS excluded, {LOOKS_LIKE_PK} AS pk_name FROM cols)"


def columns(spark, sf_dir):
    """(table, column, type) of all tables, on the driver."""
    return [(t, f.name, catalog.type_name(f.dataType)) for t, df in frames(spark, sf_dir, TABLES).items() for f in df.schema.fields]


def table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- names


@query("name_tokens", f"WITH {COLS} SELECT DISTINCT c AS column_name, CAST(i AS INTEGER) AS position, {tokens('c')}[i] AS token FROM cols, LATERAL (SELECT unnest(range(1, len({tokens('c')}) + 1)) AS i)")
def name_tokens(spark, sf_dir):
    names = {c for _, c, _ in columns(spark, sf_dir)}
    return table(spark, [(c, i, x) for c in names for i, x in enumerate(N.identifier_tokens(c), 1)], "column_name string, position int, token string")


@query("name_forms", f"WITH {COLS} SELECT DISTINCT c AS column_name, regexp_replace(upper(c), '^[A-Z]_', '') AS sanitized, {stem('c')} AS stem, {suffix('c')} AS suffix, CASE WHEN regexp_replace(regexp_replace(lower(c), '^[a-z0-9]{{1,2}}_', ''), '_?(key|id|num|no)$', '') = '' THEN lower(c) ELSE trim(regexp_replace(regexp_replace(lower(c), '^[a-z0-9]{{1,2}}_', ''), '_?(key|id|num|no)$', ''), '_') END AS core FROM cols")
def name_forms(spark, sf_dir):
    """Sanitized names, key stems and suffixes, core entities."""
    names = {c for _, c, _ in columns(spark, sf_dir)}
    return table(spark, [(c, N.sanitize_identifier_name(c), *N.key_stem(c), N.core_entity(c)) for c in names], "column_name string, sanitized string, stem string, suffix string, core string")


@query("table_entities", f"WITH {COLS} SELECT DISTINCT t AS table_name, entity FROM cols")
def table_entities(spark, sf_dir):
    return table(spark, [(t, "_".join(N.entity_tokens(t))) for t in TABLES], "table_name string, entity string")


@query("singular_words", f"WITH w AS (SELECT DISTINCT unnest(string_split(upper(n_name), ' ')) AS word FROM nation UNION SELECT upper(table_name) FROM information_schema.tables WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)}) UNION SELECT upper(p_type) FROM (SELECT unnest(string_split(p_type, ' ')) AS p_type FROM part) UNION SELECT upper(x) || y FROM (SELECT unnest(string_split(p_type, ' ')) AS x FROM part), (SELECT unnest(['S', 'ES', 'IES']) AS y)) SELECT word, {singular('word')} AS singular FROM w")
def singular_words(spark, sf_dir):
    f = frames(spark, sf_dir, ["nation", "part"])
    words = {w for r in f["nation"].select("n_name").collect() for w in r[0].upper().split(" ")} | {t.upper() for t in TABLES}
    kinds = {r[0].upper() for r in f["part"].select(F.explode(F.split("p_type", " "))).distinct().collect()}
    words |= kinds | {k + e for k in kinds for e in ("S", "ES", "IES")}
    return table(spark, [(w, N.singularize(w)) for w in words], "word string, singular string")


@query("valid_identifiers", "SELECT name, trim(regexp_replace(regexp_replace(name, '[^0-9A-Za-z_$]', '_', 'g'), '_+', '_', 'g'), '_') AS normalized, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*') AS valid FROM (SELECT n_name AS name FROM nation UNION SELECT c_name FROM customer UNION SELECT p_type FROM part)")
def valid_identifiers(spark, sf_dir):
    f = frames(spark, sf_dir, ["nation", "customer", "part"])
    names = f["nation"].select("n_name").union(f["customer"].select("c_name")).union(f["part"].select("p_type")).distinct()
    return table(spark, [(r[0], N.normalize_identifier(r[0]), N.is_valid_identifier(r[0])) for r in names.toLocalIterator()], "name string, normalized string, valid boolean")


@query("safe_names", "SELECT n_nationkey, regexp_replace(lower(n_name), ' ', '_', 'g') || CASE WHEN copy > 1 THEN '_' || copy ELSE '' END AS safe, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') || CASE WHEN copy > 1 THEN '_' || copy ELSE '' END AS slug, n_name || CASE WHEN copy > 1 THEN ' (' || copy || ')' ELSE '' END AS query_name, '`' || n_name || '`' AS quoted FROM nation, (SELECT unnest([1, 2]) AS copy)")
def safe_names(spark, sf_dir):
    """Names that weren't used yet, in the order of keys, each name twice."""
    nations = [tuple(r) for r in frames(spark, sf_dir, ["nation"])["nation"].select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    safe, slugs, queries, rows = set(), set(), set(), []
    for _ in range(2):
        rows += [(k, N.safe_semantic_identifier(n, safe), N.sanitize_slug(n, slugs), N.sanitize_query_name(n, queries), N.quote_identifier(n)) for k, n in nations]
    return table(spark, rows, "n_nationkey int, safe string, slug string, query_name string, quoted string")


@query("quoted_names", f"WITH {COLS} SELECT t || '.' || c AS name, '`' || t || '`.`' || c || '`' AS quoted, t AS first, c AS last, lower(replace(replace(t || ' ' || c, '-', '_'), ' ', '_')) AS snake FROM cols")
def quoted_names(spark, sf_dir):
    rows = []
    for t, c, _ in columns(spark, sf_dir):
        first, last = N.split_identifier(f'`{t}`."{c}"')
        rows.append((f"{t}.{c}", N.join_quoted(first, f"`{last}`"), first, last, N.to_snake_case(f"{t} {c}")))
    return table(spark, rows, "name string, quoted string, first string, last string, snake string")


@query("column_kinds", f"WITH {COLS}, {COLS2} SELECT t AS table_name, c AS column_name, family, key_family, len(list_filter({tokens('c')}, lambda x : x NOT IN ({', '.join(f"'{w}'" for w in sorted(R.GENERIC_TOKENS))}))) = 0 AS generic, identifier_like, identifier_like AND key_family IS NOT NULL AND NOT {any_of('c', R.NOT_IDENTIFIERS - {'NUMBER', 'DATE', 'ADDRESS'})} AS could_be_identifier, excluded, family = 'time' OR (family = 'categorical' AND {any_of('c', R.TIME_WORDS)}) AS time_like FROM named")
def column_kinds(spark, sf_dir):
    """Type and key families, generic and identifier-like names, columns that are never keys, and time-like columns."""
    rows = [(t, c, N.type_family(k), N.key_family(k), N.is_generic_identifier(c), N.is_identifier_like(c), N.could_be_identifier(c, k), N.excluded_from_matching(c, k), N.is_time_like(c, k)) for t, c, k in columns(spark, sf_dir)]
    return table(spark, rows, "table_name string, column_name string, family string, key_family string, generic boolean, identifier_like boolean, could_be_identifier boolean, excluded boolean, time_like boolean")


@query("entity_keys", f"WITH {COLS} SELECT a.t AS table_name, a.c AS column_name FROM (SELECT *, {LOOKS_LIKE_PK} AS pk_name FROM cols) a WHERE pk_name")
def entity_keys(spark, sf_dir):
    """Columns named like the key of their table."""
    return table(spark, [(t, c) for t, c, _ in columns(spark, sf_dir) if N.looks_like_primary_key(t, c)], "table_name string, column_name string")


@query("foreign_key_names", f"WITH {COLS}, p AS (SELECT DISTINCT t AS pt, entity AS pe FROM cols), j AS (SELECT t, c, stem, suffix, entity AS own, pt, pe AS entity FROM cols JOIN p ON t <> pt) SELECT t AS child_table, c AS column_name, pt AS parent_table FROM j WHERE suffix <> '' AND stem <> '' AND own <> stem AND ({ENTITY_MATCH} OR ends_with(stem, '_' || entity))")
def foreign_key_names(spark, sf_dir):
    """Columns named like a reference to another table."""
    return table(spark, [(t, c, p) for t, c, _ in columns(spark, sf_dir) for p in TABLES if p != t and N.looks_like_foreign_key(t, p, c)], "child_table string, column_name string, parent_table string")


@query("column_mentions", f"WITH {COLS}, w AS (SELECT DISTINCT t, c, {singular('x')} AS word FROM cols, LATERAL (SELECT unnest(string_split(stem, '_')) AS x) WHERE x <> '' AND x NOT IN ({', '.join(f"'{g}'" for g in sorted(R.GENERIC_TOKENS))})), p AS (SELECT DISTINCT t AS pt, entity AS pe FROM cols) SELECT DISTINCT t AS table_name, c AS column_name, pt AS mentioned FROM w, p WHERE word = pe OR {variants('word', 'pe')}")
def column_mentions(spark, sf_dir):
    return table(spark, [(t, c, p) for t, c, _ in columns(spark, sf_dir) for p in TABLES if N.column_mentions_table(c, p)], "table_name string, column_name string, mentioned string")


@query("shared_prefixes", f"WITH {COLS}, f AS (SELECT {tokens('c')}[1] AS prefix FROM cols WHERE len({tokens('c')}) > 1 AND length({tokens('c')}[1]) <= 3) SELECT prefix FROM f GROUP BY prefix HAVING count(*) >= 2")
def shared_prefixes(spark, sf_dir):
    return table(spark, [(p,) for p in N.global_prefixes([c for _, c, _ in columns(spark, sf_dir)])], "prefix string")


@query("table_prefixes", f"WITH n AS (SELECT p || '_' || table_name AS name, upper(p) AS p FROM information_schema.tables, (SELECT unnest(['dim', 'fact', 'stg', 'my']) AS p) WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})) SELECT DISTINCT name, unnest([p, left(p, 1), left(p, 2), left(p, 3)]) AS prefix FROM n WHERE p <> 'MY'")
def table_prefixes(spark, sf_dir):
    names = [f"{p}_{t}" for p in ("dim", "fact", "stg", "my") for t in TABLES]
    return table(spark, [(n, p) for n in names for p in N.table_prefixes(n)], "name string, prefix string")


@query("noise_tables", f"WITH n AS (SELECT unnest([table_name, 'tmp_' || table_name, table_name || '_bak', table_name || '_v2', table_name || '_20240131', '_' || table_name, table_name || '_2024_01', 'x' || table_name]) AS name FROM information_schema.tables WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})) SELECT name FROM n WHERE " + " OR ".join(f"regexp_matches(name, '{p}', 'i')" for p in R.NOISE_TABLES))
def noise_tables(spark, sf_dir):
    names = [n for t in TABLES for n in (t, f"tmp_{t}", f"{t}_bak", f"{t}_v2", f"{t}_20240131", f"_{t}", f"{t}_2024_01", f"x{t}")]
    return table(spark, [(n,) for n in names if N.is_noise_table(n)], "name string")


@query("fk_patterns", f"WITH {COLS}, k AS (SELECT DISTINCT c FROM cols WHERE suffix <> ''), p AS (SELECT x.c AS child, y.c AS parent, CASE WHEN contains(x.c, '_') THEN x.c[position('_' IN x.c) + 1:] ELSE x.c END AS a, CASE WHEN contains(y.c, '_') THEN y.c[position('_' IN y.c) + 1:] ELSE y.c END AS b FROM k x JOIN k y ON x.c <> y.c) SELECT child, parent FROM p WHERE a = b OR (length(parent) >= 4 AND contains(child, parent)) OR (length(child) >= 4 AND contains(parent, child))")
def fk_patterns(spark, sf_dir):
    names = sorted({c for _, c, _ in columns(spark, sf_dir) if N.key_stem(c)[1]})
    return table(spark, [(a, b) for a in names for b in names if a != b and N.follows_fk_pattern(a, b)], "child string, parent string")


_WORDS = {k: text_list(v) for k, v in R.METRIC_WORDS.items()}
PHRASES = ["total amount", "average price", "number of orders", "how many unique users", "distinct count", "quantity times price", "mean tax per order", "discounted revenue", "headcount", "unique number", "product of both", "sales"]


@query("metric_intents", "WITH p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PHRASES) + f"]) AS phrase), w AS (SELECT phrase, string_split(phrase, ' ') AS w FROM p) SELECT phrase, CASE WHEN list_has_any(w, {_WORDS['avg']}) OR contains(phrase, 'per order') OR contains(phrase, 'per customer') THEN 'avg' WHEN list_has_any(w, {_WORDS['count']}) OR contains(phrase, 'number of') OR contains(phrase, 'how many') THEN CASE WHEN list_has_any(w, {_WORDS['distinct']}) THEN 'count_distinct' ELSE 'count' END WHEN list_has_any(w, {_WORDS['product']}) OR contains(phrase, 'product of') THEN 'product' ELSE 'sum' END AS intent FROM w")
def metric_intents(spark, sf_dir):
    return table(spark, [(p, MT.metric_intent(p)) for p in PHRASES], "phrase string, intent string")


@query("metric_from_words", "SELECT o_orderpriority, round(avg(CAST(o_totalprice AS DECIMAL(14,2))), 4) AS average, count(o_totalprice) AS number, count(DISTINCT o_custkey) AS buyers, count(*) AS n_rows FROM orders GROUP BY 1")
def metric_from_words(spark, sf_dir):
    """Aggregates chosen by words: average, count, distinct count, and the count of rows without a source."""
    one = lambda words, c, t: MT.metric_expression(MT.metric_intent(words), [(c, t)])
    df = frames(spark, sf_dir)["orders"].withColumn("price", F.col("o_totalprice").cast("decimal(14,2)"))
    return df.groupBy("o_orderpriority").agg(
        F.round(F.expr(one("average price", "price", "DECIMAL")), 4).cast("double").alias("average"), F.expr(one("number of orders", "o_totalprice", "DOUBLE")).alias("number"),
        F.expr(one("unique number of buyers", "o_custkey", "BIGINT")).alias("buyers"), F.expr(MT.metric_expression("sum", [])).alias("n_rows"),
    )


@query("literals", "SELECT DISTINCT n_name AS value, '''' || replace(n_name, '''', '''''') || '''' AS quoted, upper(trim(n_name)) IN ('', 'N/A', 'NA', 'NAN', 'NONE', 'NOT AVAILABLE', 'NULL') AS nullish, upper(n_name) IN ('TRUE', 'YES', 'Y', '1', 'T') AS truthy FROM (SELECT n_name FROM nation UNION SELECT unnest(['it''s', 'n/a', ' none ', 'yes', '1', 'NULL']))")
def literals(spark, sf_dir):
    values = {r[0] for r in frames(spark, sf_dir, ["nation"])["nation"].select("n_name").collect()} | {"it's", "n/a", " none ", "yes", "1", "NULL"}
    return table(spark, [(v, N.format_literal(v, "STRING"), N.is_nullish(v), N.truthy(v)) for v in values], "value string, quoted string, nullish boolean, truthy boolean")


# ---- catalog


@query("catalog_tables", f"SELECT table_name FROM information_schema.tables WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})")
def catalog_tables(spark, sf_dir):
    for n, df in frames(spark, sf_dir, TABLES).items():
        df.createOrReplaceTempView(f"listed_{n}")
    return table(spark, [(t.removeprefix("listed_"),) for t in catalog.tables(spark) if t.startswith("listed_")], "table_name string")


@query("described_columns", f"WITH {COLS} SELECT t AS table_name, c AS column_name, {SPARK_TYPE} AS data_type FROM cols WHERE data_type NOT LIKE '%[]'")
def described_columns(spark, sf_dir):
    rows = []
    for n, df in frames(spark, sf_dir, TABLES).items():
        df.createOrReplaceTempView(f"listed_{n}")
        rows += [(n, c, t) for c, t in catalog.describe(spark, f"listed_{n}").items() if t != "ARRAY"]
    return table(spark, rows, "table_name string, column_name string, data_type string")


@query("metadata_tables", f"WITH {COLS}, {COLS2} SELECT upper(t) AS table_name, c AS column_name, {SPARK_TYPE} AS data_type, pk_name AND t <> 'labels' AS is_primary_key FROM named WHERE data_type NOT LIKE '%[]'")
def metadata_tables(spark, sf_dir):
    """Tables from a metadata frame, keys marked in it."""
    rows = [(t, c, k, N.looks_like_primary_key(t, c) and t != "labels") for t, c, k in columns(spark, sf_dir) if k != "ARRAY"]
    meta = table(spark, rows, "TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, IS_PRIMARY_KEY boolean")
    return table(spark, [(t.name, c.name, c.data_type, c.is_primary_key) for t in catalog.tables_from_metadata(meta) for c in t.columns], "table_name string, column_name string, data_type string, is_primary_key boolean")


@query("definition_tables", f"WITH {COLS} SELECT 'SHOP' AS database, 'PUBLIC' AS schema, upper(t) AS table_name, c AS column_name, upper(data_type) AS data_type FROM cols")
def definition_tables(spark, sf_dir):
    """Tables from dictionaries with two-part names; the database is the default."""
    kinds = {"INT": "INTEGER", "STRING": "VARCHAR", "TIMESTAMP_NTZ": "TIMESTAMP", "ARRAY": "FLOAT[]"}
    defs: dict[str, dict] = {}
    for t, c, k in columns(spark, sf_dir):
        defs.setdefault(t, {"name": f"PUBLIC.{t}", "columns": []})["columns"].append({"column_name": c, "data_type": kinds.get(k, k)})
    rows = [(t.database, t.schema, t.name, c.name, c.data_type) for t in catalog.tables_from_definitions(list(defs.values()), "SHOP") for c in t.columns]
    return table(spark, rows, "database string, schema string, table_name string, column_name string, data_type string")


@query("bound_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000.5 GROUP BY 1")
def bound_parameters(spark, sf_dir):
    frames(spark, sf_dir)["orders"].createOrReplaceTempView("bound_orders")
    return catalog.query(spark, "SELECT o_orderpriority, count(*) AS n FROM bound_orders WHERE o_orderstatus = :status AND o_totalprice >= :least GROUP BY 1", status="O", least=1000.5)


@query("domain_of_values", "SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2 UNION ALL SELECT 'lang', lang FROM documents WHERE lang IS NOT NULL GROUP BY 2")
def domain_of_values(spark, sf_dir):
    f = frames(spark, sf_dir, ["orders", "documents"])
    return catalog.distinct_values(f["orders"], "o_orderpriority").unionAll(catalog.distinct_values(f["documents"], "lang"))


@query("shared_values", "SELECT DISTINCT s_nationkey AS value FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)")
def shared_values(spark, sf_dir):
    f = frames(spark, sf_dir)
    return I.shared_values(f["supplier"], "s_nationkey", f["customer"], "c_nationkey")


@query("small_domains", "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2")
def small_domains(spark, sf_dir):
    """Columns of orders with at most five values, with all of them."""
    from .operators.filters import small_domains as domains

    found = domains(frames(spark, sf_dir)["orders"])
    return table(spark, [(c, v) for c, values in found.items() for v in values], "column_name string, value string")


@query("suggested_filters", "WITH v AS (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2) SELECT c || '_values' AS name, c || ' IN (' || string_agg('''' || v || '''', ', ' ORDER BY v) || ')' AS expr FROM v GROUP BY c UNION ALL SELECT 'o_orderdate_last_30_days', 'o_orderdate >= date_sub(current_date(), 30)'")
def suggested_filters(spark, sf_dir):
    from .operators import filters as SF

    orders = frames(spark, sf_dir)["orders"]
    found = SF.suggest(catalog.tables_from_frames({"orders": orders})[0], SF.small_domains(orders))
    return table(spark, [(f.name, f.expr) for f in found], "name string, expr string")


@query("recent_filter", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= current_date - 30000")
def recent_filter(spark, sf_dir):
    """The suggested filter with the clock's date, over enough days to have rows."""
    from .operators import filters as SF

    return frames(spark, sf_dir)["orders"].filter(SF.recent_filter("o_orderdate", 30_000).expr).agg(F.count("*").alias("n"))


@query("adaptive_thresholds", "WITH u AS (SELECT count(DISTINCT l_orderkey) / count(*) AS u FROM lineitem UNION ALL SELECT count(DISTINCT l_partkey) / count(*) FROM lineitem), k AS (SELECT max(n) / min(n) AS s FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) UNION ALL SELECT max(n) / min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)), m AS (SELECT (SELECT avg(u) FROM u) AS u, (SELECT avg(s) FROM k) AS s) SELECT CAST(greatest(10, round_even(50.0::DOUBLE * (CASE WHEN u > 0.9 THEN 0.6 WHEN u > 0.7 THEN 0.8 ELSE 1 END) * (CASE WHEN s > 10 THEN 1.5 WHEN s > 5 THEN 1.2 ELSE 1 END) * 1.1 * 2.0, 0)) AS INTEGER) AS min_sample_size, round(least(0.99, 0.95::DOUBLE * (CASE WHEN s > 10 THEN 1.02 WHEN s > 5 THEN 1.01 ELSE 1 END)), 6) AS uniqueness, round(greatest(0.4, 0.6::DOUBLE * (CASE WHEN u > 0.9 THEN 0.9 WHEN u > 0.7 THEN 0.95 ELSE 1 END)), 6) AS similarity FROM m")
def adaptive_thresholds(spark, sf_dir):
    """Of two key columns, samples of 100 values, and seven tables."""
    df = frames(spark, sf_dir)["lineitem"]
    cols = ["l_orderkey", "l_partkey"]
    keyed = {r["column_name"]: r for r in I.key_counts({"lineitem": (df, cols)}).collect()}
    skews = [r["max_freq"] / r["min_freq"] for r in P.frequency_skew(df, cols).collect()]
    t = P.adaptive_thresholds([keyed[c]["ndv"] / keyed[c]["non_null"] for c in cols], skews, [100, 100], 7)
    return table(spark, [(t.min_sample_size, round(t.uniqueness, 6), round(t.similarity, 6))], "min_sample_size int, uniqueness double, similarity double")


# ---- relationships by rules

_IDS = {"integer": "INT", "string": "STRING"}
ROLES = f"""roles AS (SELECT t, max(entity) AS entity, count(*) AS n, count(*) FILTER (WHERE identifier_like AND key_family IS NOT NULL) AS ids, count(*) FILTER (WHERE family = 'numeric' AND NOT identifier_like) AS measures,
  bool_or(pk_name AND key_family IS NOT NULL) AS has_key FROM named GROUP BY t),
role AS (SELECT t, CASE {' '.join(f"WHEN entity IN ({', '.join(chr(39) + w + chr(39) for w in sorted(words))}) THEN '{r}'" for r, words in R.ROLE_WORDS.items())}
  WHEN ids / n > 0.6 AND n <= 10 AND ids >= 2 THEN 'bridge' WHEN measures / n > 0.2 AND ids >= 2 THEN 'fact' WHEN has_key AND measures / n < 0.1 THEN 'dimension' ELSE 'unknown' END AS role FROM roles)"""


@query("table_roles", f"WITH {COLS}, {COLS2}, {ROLES} SELECT t AS table_name, role FROM role")
def table_roles(spark, sf_dir):
    raws = catalog.tables_from_frames(frames(spark, sf_dir, TABLES))
    return table(spark, [(t.name, D.table_role(t, D.primary_key(t, raws))) for t in raws], "table_name string, role string")


@query("role_contexts", f"WITH {COLS}, {COLS2}, {ROLES} SELECT a.t AS child_table, b.t AS parent_table, CASE WHEN (a.role, b.role) IN (('fact', 'dimension'), ('dimension', 'fact')) THEN a.role || '_to_' || b.role WHEN 'bridge' IN (a.role, b.role) THEN 'bridge_relationship' WHEN a.role = 'dimension' AND b.role = 'dimension' THEN 'dimension_hierarchy' WHEN a.role = 'fact' AND b.role = 'fact' THEN 'fact_to_fact' WHEN 'staging' IN (a.role, b.role) THEN 'staging_relationship' ELSE 'unknown_relationship' END AS context FROM role a JOIN role b ON a.t <> b.t")
def role_contexts(spark, sf_dir):
    raws = catalog.tables_from_frames(frames(spark, sf_dir, TABLES))
    roles = {t.name: D.table_role(t, D.primary_key(t, raws)) for t in raws}
    return table(spark, [(a, b, C.context(roles[a], roles[b])) for a in roles for b in roles if a != b], "child_table string, parent_table string, context string")


@query("business_entities", "WITH n AS (SELECT table_name AS t FROM information_schema.tables WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")) SELECT t AS table_name, CASE " + " ".join(f"WHEN regexp_matches(upper(t), '{'|'.join(words)}') THEN '{kind}'" for kind, (words, _) in R.BUSINESS_ENTITIES.items()) + " END AS entity, CASE " + " ".join(f"WHEN regexp_matches('DIM_' || upper(t), '{'|'.join(parts)}') THEN '{kind}'" for kind, parts in R.CONVENTIONS.items()) + " END AS convention FROM n")
def business_entities(spark, sf_dir):
    """The business entity of each table by its name, and the convention that its name would follow with a prefix."""
    return table(spark, [(t, C.business_entity(t), C.naming_convention(f"dim_{t}")) for t in TABLES], "table_name string, entity string, convention string")


@query("pair_scores", f"""WITH {COLS}, k AS (SELECT DISTINCT c, lower(stem) AS core FROM cols WHERE suffix IN ('KEY', 'ID')), p AS (SELECT x.c AS a, y.c AS b, x.core AS ca, y.core AS cb, upper(x.core) AS ua, upper(y.core) AS ub FROM k x JOIN k y ON x.c < y.c),
s AS (SELECT *, CASE WHEN ca = cb THEN 0.95::DOUBLE WHEN {variants(singular('ua'), singular('ub'))} THEN 0.9::DOUBLE ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS similarity,
 CASE WHEN ca = cb THEN 0.5::DOUBLE WHEN {variants(singular('ua'), singular('ub'))} OR ends_with(ca, cb) OR ends_with(cb, ca) THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS entity,
 CASE WHEN a[position('_' IN a) + 1:] = b[position('_' IN b) + 1:] OR (length(b) >= 4 AND contains(a, b)) OR (length(a) >= 4 AND contains(b, a)) THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS pattern FROM p)
SELECT a, b, round(similarity + entity + pattern, 6) AS score, CASE WHEN ends_with(ca, cb) OR ends_with(cb, ca) THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS least FROM s""")
def pair_scores(spark, sf_dir):
    names = sorted({c for _, c, _ in columns(spark, sf_dir) if N.key_stem(c)[1] in ("KEY", "ID")})
    return table(spark, [(a, b, C.pair_score(a, b), C.least_score(a, b)) for a in names for b in names if a < b], "a string, b string, score double, least double")


# ---- SQL of discovery, over the names and the values of all key columns; the queries are in queries.py

#: Whole-number columns with the name of a key, whose values the SQL reads.
VALUES_OF = [("lineitem", "l_linenumber"), *((t, c) for t, cols in (KEY_COLUMNS | {"documents": ["doc_id"], "labels": ["doc_id"], "events": ["event_id", "user_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id"]}).items() for c in cols)]
_RELATIONAL = ", ".join(f"'{t}'" for t in RELATIONAL)
HELD = "held AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v FROM {t}" for t, c in VALUES_OF) + ")"
COUNTED = "counted AS (SELECT t, c, count(*) AS n_rows, count(v) AS n, count(DISTINCT v) AS ndv FROM held GROUP BY 1, 2)"


def primary_keys_sql(then: str) -> str:
    """Named keys, else an initial with ID or KEY; then: of the first, a condition on the counts k."""
    order = "(stem = entity) DESC, (suffix IN ('KEY', 'ID')) DESC, ordinal"
    return (
        f"by_name AS (SELECT t, c, stem, key_family, 'name' AS source, row_number() OVER (PARTITION BY t ORDER BY {order}) AS r FROM named LEFT JOIN counted k USING (t, c) WHERE key_family IS NOT NULL AND pk_name AND NOT {any_of('c', R.SYSTEM_ACTIONS)} AND {then}),"
        " by_initial AS (SELECT t, c, stem, key_family, 'initial' AS source, row_number() OVER (PARTITION BY t ORDER BY ordinal) AS r FROM named WHERE key_family IS NOT NULL AND length(stem) = 1 AND suffix IN ('ID', 'KEY') AND starts_with(entity, stem)),"
        " pk AS (SELECT * FROM by_name WHERE r = 1 UNION ALL SELECT * FROM by_initial WHERE r = 1 AND t NOT IN (SELECT t FROM by_name))"
    )


#: Each column's best parents by name, and of these the edges that the values bear out.
PROVEN = f"""{primary_keys_sql('true')},
proposed AS (SELECT a.t, a.c, p.t AS pt, p.c AS pc, CASE WHEN a.stem = p.stem THEN 3 WHEN {variants('a.stem', 'p.stem')} THEN 2 WHEN ends_with(a.stem, '_' || p.stem) OR {variants('a.stem', 'e.entity')} THEN 1 ELSE 0 END AS tier
  FROM (SELECT * FROM named WHERE suffix <> '' AND stem <> '' AND NOT excluded) a JOIN pk p ON a.t <> p.t AND a.key_family = p.key_family AND p.stem <> '' JOIN (SELECT DISTINCT t, entity FROM named) e ON e.t = p.t WHERE (a.t, a.c) NOT IN (SELECT (t, c) FROM pk)),
ranked AS (SELECT *, rank() OVER (PARTITION BY t, c ORDER BY tier DESC) AS rnk FROM proposed WHERE tier > 0),
best AS (SELECT * FROM ranked WHERE rnk = 1),
parents AS (SELECT DISTINCT t, c, v FROM held WHERE v IS NOT NULL),
proof AS (SELECT b.t, b.c, b.pt, b.pc, b.rnk, count(DISTINCT h.v) AS ndv, count(DISTINCT p.v) AS shared, count(*) FILTER (WHERE h.v IS NULL OR p.v IS NULL) AS lost FROM best b JOIN held h ON h.t = b.t AND h.c = b.c LEFT JOIN parents p ON p.t = b.pt AND p.c = b.pc AND p.v = h.v GROUP BY ALL),
proven AS (SELECT f.*, a.n = a.ndv AS once FROM proof f JOIN counted a ON a.t = f.t AND a.c = f.c JOIN counted k ON k.t = f.pt AND k.c = f.pc WHERE k.n = k.ndv AND f.shared >= 0.5 * f.ndv)"""
_NAMED = f"WITH {COLS}, {COLS2}, {HELD}, {COUNTED}"

ORACLES["key_candidates"] = f"WITH {COLS}, {COLS2} SELECT t AS table_name, c AS column_name FROM named WHERE t IN ({_RELATIONAL}) AND key_family IS NOT NULL AND NOT excluded AND (identifier_like OR key_family = 'integer')"
ORACLES["pk_candidates"] = f"{_NAMED}, {primary_keys_sql('coalesce(k.ndv / k.n, 1) >= 0.9')} SELECT t AS table_name, c AS column_name, source AS pk_source FROM pk WHERE t IN ({_RELATIONAL})"
ORACLES["relationships"] = f"{_NAMED}, {PROVEN} SELECT t AS left_table, c AS left_columns, pt AS right_table, pc AS right_columns, CASE WHEN once THEN 'one_to_one' ELSE 'many_to_one' END AS relationship_type, CASE WHEN lost > 0 THEN 'left_outer' ELSE 'inner' END AS join_type FROM proven"
ORACLES["fk_candidates_ranked"] = f"{_NAMED}, {PROVEN} SELECT t AS left_table, c AS left_columns, pt AS right_table, pc AS right_columns, CAST(rnk AS INTEGER) AS rnk FROM proven"


# ---- SQL of the partner merge: the two sides as they are written down, and the join


def _partner_sql() -> str:
    t = tpch_model().table("orders")
    text = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"
    ours = [(c.name, c.expr, c.data_type, s) for s, cols in (("dimensions", t.dimensions), ("time_dimensions", t.time_dimensions), ("measures", t.facts)) for c in cols]
    theirs = [(d["name"], d.get("expr", d["name"]), d.get("type", ""), s) for m in DBT for s in ("entities", "dimensions", "measures") for d in m[s]]
    return f"""WITH a AS (SELECT *, upper(expr) AS k FROM {text(ours)} v(name, expr, kind, section)),
b AS (SELECT name, expr, upper(expr) AS k, CASE WHEN section = 'measures' THEN 'NUMBER' WHEN kind = 'time' THEN 'DATETIME' ELSE 'TEXT' END AS kind, CASE WHEN section = 'measures' THEN section WHEN kind = 'time' THEN 'time_dimensions' ELSE 'dimensions' END AS section FROM {text(theirs)} v(name, expr, kind, section))
SELECT coalesce(a.k, b.k) AS field_key, coalesce(a.section, b.section) AS section, coalesce(nullif(a.kind, ''), nullif(b.kind, ''), 'TEXT') AS data_type, coalesce(nullif(a.name, ''), b.name) AS name, coalesce(nullif(a.expr, ''), b.expr) AS expr,
  CASE WHEN a.k IS NULL THEN 'partner' WHEN b.k IS NULL THEN 'ours' ELSE 'merged' END AS origin FROM a FULL JOIN b ON a.k = b.k"""


ORACLES["partner_merge"] = _partner_sql()


# ---- models


def _fields_sql(then: str) -> str:
    return f"WITH {COLS}, {COLS2} {then}"


@query("raw_table_fields", _fields_sql(f"SELECT t AS table_name, c AS column_name, CASE WHEN family = 'time' OR (family = 'categorical' AND {any_of('c', R.TIME_WORDS)}) THEN 'time_dimensions' WHEN family = 'numeric' AND NOT (identifier_like AND key_family IS NOT NULL AND NOT {any_of('c', R.NOT_IDENTIFIERS - {'NUMBER', 'DATE', 'ADDRESS'})}) THEN 'facts' ELSE 'dimensions' END AS section FROM named WHERE family <> 'object'"))
def raw_table_fields(spark, sf_dir):
    """The section of every column of a logical table made from a raw one."""
    from .plans.build import table_from_raw

    made = [table_from_raw(t) for t in catalog.tables_from_frames(frames(spark, sf_dir, TABLES))]
    return table(spark, [(t.base_table.table, c.expr, s) for t in made for s in ("dimensions", "time_dimensions", "facts") for c in getattr(t, s)], "table_name string, column_name string, section string")


@query("model_round_trip", _fields_sql("SELECT t AS table_name, '__' || lower(t) AS logical_name, c AS column_name, 'column' AS kind FROM named WHERE family <> 'object'"))
def model_round_trip(spark, sf_dir):
    """A model of all tables as YAML and back, its columns in one list."""
    from .plans.build import table_from_raw

    model = SemanticModel("all", tables=[table_from_raw(t) for t in catalog.tables_from_frames(frames(spark, sf_dir, TABLES))])
    back = M.from_yaml(M.to_yaml(model))
    return table(spark, [(t.base_table.table, logical.logical_name(t.base_table.table), c.expr, "column") for t in map(M.column_format, back.tables) for c in t.columns], "table_name string, logical_name string, column_name string, kind string")


WANTED = [("orders", "o_orderkey"), ("orders", "o_total"), ("customer", "c_name"), ("customer", "c_phone"), ("nation", "n_name"), ("lineitem", "l_tax"), ("lineitem", "l_comment")]


@query("binding_problems", "SELECT v.t AS table_name, v.c AS column_name FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in WANTED) + ") v(t, c) WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns i WHERE i.table_name = v.t AND i.column_name = v.c)")
def binding_problems(spark, sf_dir):
    """Fields of models that their tables don't have, by binding one field at a time."""
    f, rows = frames(spark, sf_dir), []
    for t, c in WANTED:
        model = SemanticModel("m", tables=[Table(t, BaseTable("", "", t), dimensions=[Column(c, c)])])
        if validate.binding_problems(spark, model, {t: f[t]}):
            rows.append((t, c))
    return table(spark, rows, "table_name string, column_name string")


@query("name_problems", "SELECT n_name AS name FROM nation WHERE NOT regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_$]*')")
def name_problems(spark, sf_dir):
    """Names of nations that can't be names of fields, by validating a model with each as a field."""
    names = [r[0] for r in frames(spark, sf_dir, ["nation"])["nation"].select("n_name").collect()]
    bad = [n for n in names if any("usable name" in p for p in validate.problems(spark, SemanticModel("m", tables=[Table("t", BaseTable("", "", "t"), dimensions=[Column(n, "x")])])))]
    return table(spark, [(n,) for n in bad], "name string")


@query("enriched_descriptions", _fields_sql(f"SELECT t AS table_name, c AS column_name, 'The ' || replace(c, '_', ' ') || ' of ' || replace(t, '_', ' ') || '.' AS description FROM named WHERE t IN ({', '.join(f"'{t}'" for t in RELATIONAL)})"))
def enriched_descriptions(spark, sf_dir):
    """Descriptions by a client that knows names only."""
    from .plans.build import table_from_raw

    model = SemanticModel("trade", description="__", tables=[table_from_raw(t) for t in catalog.tables_from_frames(frames(spark, sf_dir))])
    enrich.enrich(spark, model, enrich.Offline(), sources={t.name: frames(spark, sf_dir)[t.base_table.table] for t in model.tables})
    return table(spark, [(t.base_table.table, c.expr, c.description) for t in model.tables for c in t.fields()], "table_name string, column_name string, description string")


@query("edited_model", "SELECT o_orderstatus, count(*) AS n_orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def edited_model(spark, sf_dir):
    """A model put together by edits: a table dropped and put, a column replaced, a relationship and filters added."""
    model = tpch_model()
    model.drop_table("lineitem")
    model.put_column("orders", "dimensions", Column("o_orderstatus", "o_orderstatus"))
    model.drop_column("orders", "o_orderpriority")
    model.put_column("orders", "dimensions", Column("priority", "o_orderpriority"))
    t = model.table("orders")
    t.metrics = [Metric("n_orders", "count(*)"), Metric("urgent", "count(*)", filter="priority = '1-URGENT'")]
    t.filters = [NamedFilter("large", "o_totalprice > 1000")]
    model.put_table(t)
    model.put_relationship(Relationship("orders_customer", "orders", "customer", [RelationKey("o_custkey", "c_custkey")]))
    return Planner(spark, model, frames(spark, sf_dir)).run(SemanticQuery(["orders.n_orders", "orders.urgent"], ["orders.o_orderstatus"], ["orders.large"]))


@query("passthrough_columns", "SELECT o_orderstatus AS status, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1")
def passthrough_columns(spark, sf_dir):
    """A base column that only an aggregate mentions is there in the view, next to the fields."""
    t = Table("o", BaseTable("", "", "orders"), columns=[Column("status", "o_orderstatus"), Column("spent", "sum(cast(o_totalprice as decimal(14,2)))")])
    v = logical.view(spark, t, frames(spark, sf_dir)["orders"])
    return v.groupBy("status").agg(F.expr(t.columns[1].expr).cast("double").alias("spent"))


@query("direct_columns", _fields_sql("SELECT c AS name, c AS reference FROM named WHERE t = 'orders'"))
def direct_columns(spark, sf_dir):
    """The fields that are nothing but a base column, and what they refer to, among others that are not."""
    cols = [f.name for f in frames(spark, sf_dir)["orders"].schema.fields]
    t = Table("o", BaseTable("", "", "orders"), columns=[*[Column(c, c) for c in cols], *[Column(f"{c}_twice", f"concat({c}, {c})") for c in cols], Column("n", "count(*)")])
    return table(spark, [(c.name, r) for c in logical.direct_columns(spark, t) for r in parse.references(spark, c.expr)], "name string, reference string")


@query("qualified_text", "SELECT n_name, count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY 1")
def qualified_text(spark, sf_dir):
    """Table names in a list after FROM, in full."""
    f = frames(spark, sf_dir)
    for n in ("customer", "nation"):
        f[n].createOrReplaceTempView(f"full_{n}")
    return spark.sql(logical.qualify("SELECT n_name, count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY 1", {n: f"full_{n}" for n in ("customer", "nation")}))


@query("ensured_limit", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def ensured_limit(spark, sf_dir):
    """A top-k report: the limit is put where there is none, and left where there is one."""
    frames(spark, sf_dir)["supplier"].createOrReplaceTempView("ranked_supplier")
    return spark.sql(logical.ensure_limit(logical.ensure_limit("SELECT s_suppkey, s_name FROM ranked_supplier ORDER BY s_acctbal DESC, s_suppkey;", 7), 3))


@query("verified_queries_run", "SELECT r_name, count(*) AS n_nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def verified_queries_run(spark, sf_dir):
    """A verified query of a model over its logical tables."""
    model = tpch_model()
    logical.register_views(spark, model, frames(spark, sf_dir))
    model.put_verified_query(VerifiedQuery("nations", "How many nations has each region?", "SELECT r_name, count(*) AS n_nations FROM __nation JOIN __region ON n_regionkey = r_regionkey GROUP BY 1"))
    return run_verified_queries(spark, model)["nations"]


@query("semantic_self_reference", "WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS before, role FROM conversations) SELECT b.role, count(*) AS n_turns FROM c a LEFT JOIN c b ON a.before = b.id GROUP BY 1")
def semantic_self_reference(spark, sf_dir):
    """Turns by the role of the turn that each one follows: a dimension over a relationship of the table with itself."""
    t = Table("turns", BaseTable("", "", "conversations"), dimensions=[Column("id", "conv_id * 1000 + turn"), Column("before", "conv_id * 1000 + turn - 1"), Column("role", "role")], metrics=[Metric("n_turns", "count(*)")])
    model = SemanticModel("chat", tables=[t], relationships=[Relationship("follows", "turns", "turns", [RelationKey("before", "id")], "left_outer")])
    return Planner(spark, model, {"turns": frames(spark, sf_dir, ["conversations"])["conversations"]}).run(SemanticQuery(["turns.n_turns"], ["turns@follows.role"]))


@query("semantic_over_bridge", "SELECT p_brand, count(DISTINCT s_suppkey) AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def semantic_over_bridge(spark, sf_dir):
    """Suppliers by brand of the parts that they deliver: over a many-to-many relationship, which the query names."""
    model = tpch_model()
    model.table("supplier").metrics = [Metric("suppliers", "count(distinct s_suppkey)")]
    model.relationships.append(Relationship("delivers", "supplier", "part", [RelationKey("l_suppkey", "l_partkey")], "inner", "many_to_many", via="lineitem"))
    return Planner(spark, model, frames(spark, sf_dir)).run(SemanticQuery(["supplier.suppliers"], ["part.p_brand"], path=["delivers"]))
