"""From tables to a semantic model."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..functions import names as N
from ..operators.discover import discover
from ..operators.filters import small_domains, suggest
from ..sources.catalog import RawTable, quick_samples, tables_from_frames
from . import parse
from .model import BaseTable, Column, PrimaryKey, SemanticModel, Table, to_yaml


def table_from_raw(raw: RawTable, reserved: frozenset[str] = frozenset(), exact_values: dict[str, list[str]] | None = None, placeholder: str = "__") -> Table:
    """Times, identifiers and text become dimensions, numbers facts; object types are left out."""
    used: set[str] = set()
    out = Table(name=N.safe_semantic_identifier(raw.name, set(), reserved, "table"), base_table=BaseTable(raw.database, raw.schema, raw.name), description=raw.comment or placeholder)
    for c in raw.columns:
        family = N.type_family(c.data_type)
        if family == "object":
            continue
        samples = [v for v in c.values if not N.is_nullish(v)]
        col = Column(N.safe_semantic_identifier(c.name, used, reserved), c.name, c.data_type, description=c.comment or placeholder, sample_values=list(dict.fromkeys(samples)))
        if N.is_time_like(c.name, c.data_type, c.values):
            col.data_type = col.data_type if family == "time" else "TIMESTAMP_NTZ"
            out.time_dimensions.append(col)
        elif family == "numeric" and not (c.is_primary_key or N.could_be_identifier(c.name, c.data_type)):
            out.facts.append(col)
        else:
            out.dimensions.append(col)
    out.filters = suggest(raw, exact_values)
    keys = [c.name for c in raw.columns if c.is_primary_key]
    out.primary_key = PrimaryKey(keys) if keys else None
    return out


def build_model(
    spark: SparkSession,
    frames: dict[str, DataFrame],
    name: str,
    *,
    n_sample_values: int = 10,
    allow_joins: bool = True,
    strict: bool = False,
    primary_keys: dict[str, list[str]] | None = None,
    client=None,
    progress: Callable[[str, float], None] | None = None,
    min_confidence: float = 0.5,
    max_workers: int = 4,
) -> SemanticModel:
    """Samples, classification, filters and relationships of all tables; with a client also descriptions (``enrich``)."""
    tell = progress or (lambda stage, share: None)
    raws, reserved = tables_from_frames(frames, primary_keys), parse.reserved_words(spark)
    model = SemanticModel(name=name, description="__")

    def look(raw: RawTable) -> dict[str, list[str]]:
        got = quick_samples(frames[raw.name], max(1, n_sample_values))
        for c in raw.columns:
            c.values = got.get(c.name, [])
        return small_domains(frames[raw.name], samples=got if n_sample_values > 5 else None)

    with ThreadPoolExecutor(max_workers) as pool:  # the jobs of several tables at a time; the order stays
        for i, (raw, domains) in enumerate(zip(raws, pool.map(look, raws), strict=True)):
            model.tables.append(table_from_raw(raw, reserved, domains))
            tell("tables", (i + 1) / len(raws))
    if allow_joins:
        # the sorted samples of two columns need not meet: evidence comes from whole tables instead
        bare = tables_from_frames(frames, primary_keys)
        names = {raw.name: t.name for raw, t in zip(raws, model.tables, strict=True)}
        for r in discover(bare, frames=frames, strict=strict, min_confidence=min_confidence).relationships():
            r.left_table, r.right_table, r.via = names[r.left_table], names[r.right_table], names.get(r.via, "")
            model.relationships.append(r)
        tell("relationships", 1.0)
    if client is not None:
        from .enrich import enrich

        enrich(spark, model, client, sources={t.name: frames[raw.name] for raw, t in zip(raws, model.tables, strict=True)})
    return model


def model_text(model: SemanticModel) -> str:
    from .validate import check_context

    check_context(model)
    return to_yaml(model)
