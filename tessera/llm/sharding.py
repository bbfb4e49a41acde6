"""Contiguous shards of equal bytes.

Documents are range-sorted by doc_id.  Each partition adds up its sizes on its own and
reports one total; the running sum of the totals gives every partition its start,
and with it every document its global byte position.  Positions are cut at equal
targets: a document belongs to the shard in which its first byte lies, so shards are
contiguous in doc_id and differ from the target by less than a document at each end.

Defined results.  Sizes are UTF-8 bytes of the text; null and empty texts have none and stay
at the place where they are (in the last shard, if at the very end).  Null doc_ids come first.
Rows of equal doc_id are ordered by size; equal rows are interchangeable.  A document of more than
the target leaves the shards that it covers empty.  Extra columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TARGET_BYTES = 32 << 20


def shards(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, start_byte, shard) for every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    ordered = docs.select(F.col("doc_id").cast("long"), size.alias("n_bytes")).repartitionByRange("doc_id", "n_bytes").sortWithinPartitions("doc_id", "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, upto = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = np.cumsum(n) + upto
            if len(n):
                upto = int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))], names=["doc_id", "n_bytes", "local", "part"])

    kept = materialize(ordered.mapInArrow(run, "doc_id long, n_bytes long, local long, part int"), "sizes")
    totals = kept.groupBy("part").agg(F.max(F.col("local") + F.col("n_bytes")).alias("bytes"))
    # one row a partition, not a document: a single running sum
    w = Window.orderBy("part")
    starts = totals.select(F.col("part").alias("o_part"), (F.sum("bytes").over(w) - F.col("bytes")).alias("offset"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    starts = materialize(starts, "starts")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("all_bytes") / F.lit(target_bytes)).cast("long"))
    each = F.greatest(F.lit(1), F.ceil(F.col("all_bytes") / n_shards).cast("long"))
    at = F.col("local") + F.col("offset")
    shard = F.least(F.floor(F.try_divide(at, each)).cast("long"), n_shards - 1)
    return kept.join(starts, F.col("part") == F.col("o_part")).select("doc_id", "n_bytes", at.alias("start_byte"), shard.cast("int").alias("shard"))


def op10_sharding(spark, sf_dir):
    from .common import table

    return shards(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(sum(n) OVER () AS BIGINT) AS a FROM d),
k AS (SELECT *, greatest(1, CAST(ceil(a / {TARGET_BYTES}::DOUBLE) AS BIGINT)) AS m FROM p)
SELECT doc_id, n AS n_bytes, s AS start_byte, CAST(least(s // greatest(1, CAST(ceil(a / m::DOUBLE) AS BIGINT)), m - 1) AS INTEGER) AS shard FROM k"""
