"""Sources: catalogs, schemas and tables of the session, dictionaries, and YAML files."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N


#: Column -> its values.
Domains = dict[str, list[str]]


class DefinitionError(ValueError):
    pass


@dataclass
class RawColumn:
    name: str
    data_type: str
    values: list[str] = field(default_factory=list)
    comment: str = ""
    is_primary_key: bool = False
    uniqueness: float | None = None

    def __post_init__(self):
        if not self.name:
            raise DefinitionError("a column needs a name")
        self.data_type = N.clean_column_type(self.data_type)


@dataclass
class RawTable:
    name: str
    columns: list[RawColumn]
    comment: str = ""
    database: str = ""
    schema: str = ""

    def column(self, name: str) -> RawColumn:
        return next(c for c in self.columns if c.name.lower() == name.lower())


def databases(spark: SparkSession) -> list[str]:
    return sorted(r[0] for r in spark.sql("SHOW CATALOGS").collect())


def schemas(spark: SparkSession, catalog: str | None = None) -> list[str]:
    rows = spark.sql(f"SHOW SCHEMAS IN {N.quote_identifier(catalog)}" if catalog else "SHOW SCHEMAS").collect()
    return [f"{catalog}.{r[0]}" if catalog else r[0] for r in rows]


def tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Tables and temporary views (not permanent views), each once."""
    found = spark.catalog.listTables(schema)
    return list(dict.fromkeys(t.name for t in found if t.tableType != "VIEW" or t.isTemporary))


def qualified_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    """Full names (catalog.schema.table) of the tables and permanent views of a schema; temporary views have bare names."""
    found = spark.catalog.listTables(schema)
    return sorted({t.name if t.isTemporary else N.join_quoted(t.catalog, *(t.namespace or []), t.name).replace("`", "") for t in found})


def walk(spark: SparkSession, schemas_of: list[str] | None = None) -> DataFrame:
    """(TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, DATA_TYPE, IS_PRIMARY_KEY, COMMENT) of all tables of the schemas (all of the session's catalog by default): metadata only."""
    rows = []
    for schema in schemas_of or schemas(spark):
        for t in spark.catalog.listTables(schema):
            if t.isTemporary:
                continue
            name = N.join_quoted(t.catalog, *(t.namespace or []), t.name)
            keys = primary_keys(spark, name) if t.tableType != "VIEW" else []
            rows += [(schema, t.name, f.name, type_name(f.dataType), f.name in keys, (f.metadata or {}).get("comment", "")) for f in spark.table(name).schema.fields]
    return spark.createDataFrame(rows, "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, IS_PRIMARY_KEY boolean, COMMENT string")


def type_name(t: T.DataType) -> str:
    """The SQL type's name; decimals keep their precision and scale."""
    names = {T.LongType: "BIGINT", T.IntegerType: "INT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.StringType: "STRING", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT"}
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return names.get(type(t)) or N.base_type(t.simpleString())


def family(t: T.DataType) -> str:
    return N.type_family(type_name(t))


def columns(spark: SparkSession, frames: dict[str, DataFrame], primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, column_name, ordinal, data_type, family, is_primary_key): metadata only, no scan."""
    keys = primary_keys or {}
    rows = [
        (name, f.name, i, type_name(f.dataType), family(f.dataType), f.name in keys.get(name, []))
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, family string, is_primary_key boolean")


def describe(spark: SparkSession, table: str) -> dict[str, str]:
    return {f.name: type_name(f.dataType) for f in spark.table(table).schema.fields}


def primary_keys(spark: SparkSession, table: str) -> list[str]:
    """From the table property ``primary_key`` (comma-separated): Spark's own catalog has no constraints."""
    for r in spark.sql(f"SHOW TBLPROPERTIES {N.join_quoted(*N.split_identifier(table))}").collect():
        if r["key"] == "primary_key":
            return [p.strip() for p in r["value"].split(",")]
    return []


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def same_schema(df: DataFrame, expected: dict[str, str]) -> bool:
    """The same set of columns, each with a type that contains the expected text."""
    have = {f.name.upper(): type_name(f.dataType).upper() for f in df.schema.fields}
    want = {k.upper(): v.upper() for k, v in expected.items()}
    return have.keys() == want.keys() and all(v in have[k] for k, v in want.items())


def _first(d: dict, *keys: str, default=None):
    return next((d[k] for k in keys if d.get(k) is not None), default)


def tables_from_definitions(definitions: list[dict], database: str = "OFFLINE", schema: str = "PUBLIC") -> list[RawTable]:
    """Tables from dictionaries; names of one to three parts."""
    if not isinstance(definitions, list):
        raise DefinitionError("a list of tables is expected")
    out = []
    for d in definitions:
        if not isinstance(d, dict) or not (name := _first(d, "table_name", "name", "table")):
            raise DefinitionError("a table needs a name")
        parts = N.split_identifier(str(name))
        if len(parts) > 3:
            raise DefinitionError(f"{name}: more than three parts")
        cols = d.get("columns")
        if not isinstance(cols, list) or not cols:
            raise DefinitionError(f"{name}: columns are missing")
        raw = []
        for c in cols:
            if not isinstance(c, dict) or not (col := _first(c, "name", "column_name")):
                raise DefinitionError(f"{name}: a column needs a name")
            values = [v for v in (_first(c, "sample_values", "values", default=[]) or [])]
            filled = [str(v) for v in values if not N.is_nullish(v)]
            raw.append(
                RawColumn(
                    str(col), str(_first(c, "type", "data_type", default="STRING")), [None if v is None else str(v) for v in values], str(_first(c, "comment", "description", default="")),
                    N.truthy(_first(c, "is_primary_key", "primary_key", "is_primary", default=False)), len(set(filled)) / len(filled) if filled else None,
                )
            )
        out.append(RawTable(parts[-1].upper(), raw, str(d.get("comment", "")), parts[-3] if len(parts) == 3 else database, parts[-2] if len(parts) > 1 else schema))
    return out


def tables_from_metadata(meta: DataFrame) -> list[RawTable]:
    """Tables from a frame of TABLE_NAME, COLUMN_NAME, DATA_TYPE and, if there, TABLE_SCHEMA, IS_PRIMARY_KEY, COMMENT."""
    have = {c.upper(): c for c in meta.columns}
    out: dict[str, RawTable] = {}
    for r in meta.collect():
        name = str(r[have["TABLE_NAME"]]).upper()
        t = out.setdefault(name, RawTable(name, [], schema=str(r[have["TABLE_SCHEMA"]]) if "TABLE_SCHEMA" in have else ""))
        t.columns.append(
            RawColumn(r[have["COLUMN_NAME"]], r[have["DATA_TYPE"]], comment=(r[have["COMMENT"]] or "") if "COMMENT" in have else "", is_primary_key=N.truthy(r[have["IS_PRIMARY_KEY"]]) if "IS_PRIMARY_KEY" in have else False)
        )
    return list(out.values())


def tables_from_frames(frames: dict[str, DataFrame], primary_keys: dict[str, list[str]] | None = None) -> list[RawTable]:
    keys = primary_keys or {}
    return [
        RawTable(name, [RawColumn(f.name, type_name(f.dataType), comment=(f.metadata or {}).get("comment", ""), is_primary_key=f.name in keys.get(name, [])) for f in df.schema.fields])
        for name, df in frames.items()
    ]


def quick_samples(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> Domains:
    """Up to n distinct values of each column, in order of appearance, from the first rows alone: max(10 n, 100) of them are read, however large the table."""
    cols = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    rows = df.select(*[F.col(c).cast("string") for c in cols]).limit(max(10 * n, 100)).collect()
    return {c: list(dict.fromkeys(r[i] for r in rows if r[i] is not None))[:n] for i, c in enumerate(cols)}


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(column_name, value): all distinct values of a column that aren't null."""
    return df.select(F.lit(column).alias("column_name"), F.col(column).alias("value")).filter("value is not null").distinct()


def sample_values(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """(column_name, position, value): the first n distinct values of each column in order of their text.

    One scan for all columns; each partition sends on n values a column, whatever its size.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import Window

    cols = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[set[str]] = [set() for _ in cols]
        for b in batches:
            for i in range(len(cols)):
                values = pc.unique(b.column(i).drop_null())
                if len(values) > n:
                    values = values.take(pc.partition_nth_indices(values, pivot=n)[:n])
                if len(values):
                    best[i] = set(sorted(best[i].union(values.to_pylist()))[:n])
        pairs = [(c, v) for c, values in zip(cols, best, strict=True) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["column_name", "value"])

    pairs = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(first, "column_name string, value string").distinct()
    w = Window.partitionBy("column_name").orderBy("value")
    return pairs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select("column_name", "position", "value")


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a folder; their schemas are read at the same time."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(lambda n: spark.read.parquet(f"{folder}/{n}.parquet"), names), strict=True))


def try_query(spark: SparkSession, sql: str, **params) -> tuple[DataFrame | None, str]:
    """(result, "") or (None, the first line of what is wrong with it); the query is analysed, not run."""
    try:
        return query(spark, sql, **params), ""
    except PySparkException as e:
        return None, str(e).strip().splitlines()[0]


def cursor(df: DataFrame, size: int = 1000) -> Iterator[list]:
    """The rows in lists of ``size``, a partition at a time on the driver."""
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL with typed named parameters (``:name``)."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def yaml_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the .yaml and .yml files of a folder, each once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path)]
    return sorted({f for f in found if f.lower().endswith((".yaml", ".yml"))})


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_dbt(text: str) -> list[dict]:
    """The ``semantic_models`` section of a dbt file."""
    return (yaml.safe_load(text) or {}).get("semantic_models") or []
