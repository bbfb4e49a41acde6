"""Sinks: model files, tables and comments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from ..functions.names import quote_identifier
from ..plans.model import SemanticModel, mark_placeholders, to_yaml


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, False)


def write_model(spark: SparkSession, model: SemanticModel, folder: str, name: str | None = None) -> str:
    """Writes the model with a banner; returns the path, which has the time in it unless a name is given."""
    stamp = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}"
    path = f"{folder.rstrip('/')}/{name or f'{model.name}_{stamp}'}.yaml"
    write_text(spark, path, "# Semantic model. Fields marked 'fill in' want a description.\n" + mark_placeholders(to_yaml(model)))
    return path


def create_table(spark: SparkSession, table: str, columns: dict[str, str], using: str = "parquet") -> None:
    body = ", ".join(f"{quote_identifier(n)} {t}" for n, t in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING {using}")


def set_table_comment(spark: SparkSession, table: str, comment: str) -> None:
    spark.sql("COMMENT ON TABLE {} IS '{}'".format(table, comment.replace("\\", "\\\\").replace("'", "\\'")))
