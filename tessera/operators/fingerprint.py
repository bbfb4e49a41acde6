"""A table's fingerprint: the same for the same rows in any order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parts(f: T.StructField) -> list[Column]:
    """What of a column is hashed: whether it is null, as hashes skip nulls, and its value; nested values as text, maps in order of their keys."""
    c = F.col("`" + f.name.replace("`", "``") + "`")
    if isinstance(f.dataType, T.MapType):
        value = F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("v")), {"ignoreNullFields": "false"})
    elif isinstance(f.dataType, T.ArrayType | T.StructType | T.VariantType):
        value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    else:
        value = c
    return [c.isNull(), value]


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, bits, total): XOR and sum of the row hashes, so that repeated rows count; ``EMPTY`` rows give zeros."""
    h = F.xxhash64(*[x for f in df.schema.fields for x in _parts(f)])
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("bits"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total")
    )
