"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the columns that operators add beside a caller's own columns.
OWN = "tessera__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a folder of
    the machine stands in when the setting is missing; it goes with the process.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


#: Folders of intermediate tables that are still there, in the order in which they were written.
_written: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``folder`` of the result is where it is.

    This cuts the lineage, survives the loss of executors, and gives the planner
    the true size of the table, by which it decides whether to broadcast it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove tables made by ``materialize``, or folders, that are no longer needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in tables:
        folder = t if isinstance(t, str) else t.folder
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _written:
            _written.remove(folder)


def mark() -> int:
    """For ``sweep``: what is written from now on."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Remove all intermediate tables written since ``mark``, but ``keep``: what was made from them must be written by then."""
    drop(spark, *[p for p in _written[since:] if p != keep.folder])


def named(name: str):
    """The column of that very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_columns(df: DataFrame) -> list:
    """All columns of ``df`` by name."""
    return [named(c) for c in df.columns]


def planned_bytes(df: DataFrame) -> int:
    """The size of ``df`` as the optimizer knows it from its files: no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def let(value, body):
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def own_name(df: DataFrame, base: str) -> str:
    """A column name made from ``base`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = OWN + base
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give a finished task's memory back to the machine: Python workers live on, idle, beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
