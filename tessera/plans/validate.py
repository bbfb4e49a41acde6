"""Validation of semantic models: structure, names, SQL, and binding to the base tables."""

from __future__ import annotations

import dataclasses
import math

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import is_valid_identifier, type_family
from . import logical, parse
from .model import AGGREGATIONS, CARDINALITIES, JOIN_TYPES, KINDS, ModelError, SemanticModel, from_yaml, to_yaml

TOKENS, BASE_TOKENS, LITERAL_TOKENS, CHARS_A_TOKEN, SAMPLES = 32_300, 1_220, 100, 4, 3


def _objects(x, where="model"):
    if dataclasses.is_dataclass(x):
        yield where, x
        for f in dataclasses.fields(x):
            yield from _objects(getattr(x, f.name), f"{where}.{f.name}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from _objects(v, f"{where}[{i}]")


def problems(spark: SparkSession, model: SemanticModel) -> list[str]:
    """What is wrong with names, enumerations, SQL text and verified queries."""
    reserved, out = parse.reserved_words(spark), []
    for where, x in _objects(model):
        for f in dataclasses.fields(x):
            v = getattr(x, f.name)
            if f.metadata.get("required") and v in ("", None):
                out.append(f"{where}: {f.name} is missing")
            elif f.metadata.get("name") and v and (not is_valid_identifier(v) or v.upper() in reserved):
                out.append(f"{where}: {v!r} isn't a usable name")
            elif f.metadata.get("sql") and v:
                whole = f.name == "sql"
                if not (parse.is_query(spark, v) if whole else parse.is_expression(spark, v)):
                    out.append(f"{where}: {f.name} isn't SQL: {v}")
        for name, allowed in (("kind", KINDS), ("default_aggregation", AGGREGATIONS), ("join_type", JOIN_TYPES), ("relationship_type", CARDINALITIES)):
            v = getattr(x, name, "")
            if v and v not in allowed:
                out.append(f"{where}: {name} {v!r} is none of {', '.join(allowed)}")
        if getattr(x, "data_type", "") and type_family(x.data_type) == "object":
            out.append(f"{where}: type {x.data_type} can't be used")
    seen = set()
    for q in model.verified_queries:
        if (q.question, q.sql) in seen:
            out.append(f"verified query {q.name} is there twice")
        seen.add((q.question, q.sql))
    tables = {t.name.lower() for t in model.tables}
    for r in model.relationships:
        for t in (r.left_table, r.right_table):
            if t.lower() not in tables:
                out.append(f"relationship {r.name}: no table {t}")
    return out


def binding_problems(spark: SparkSession, model: SemanticModel, sources: dict[str, DataFrame] | None = None) -> list[str]:
    """Fields, metrics and filters that the analyser rejects against the base tables."""
    out = []
    for t in model.tables:
        try:
            v = logical.view(spark, t, (sources or {}).get(t.name))
            v.schema  # noqa: B018
        except (AnalysisException, ParseException, ModelError) as e:
            out.append(f"{t.name}: {str(e).splitlines()[0]}")
            continue
        for kind, items in (("metric", t.metrics), ("filter", t.filters)):
            for m in items:
                try:
                    (v.agg(_expr(m.expr)) if kind == "metric" else v.filter(parse.normalize_dialect(m.expr))).schema  # noqa: B018
                except (AnalysisException, ParseException) as e:
                    out.append(f"{t.name}.{m.name}: {str(e).splitlines()[0]}")
    return out


def _expr(e: str):
    from pyspark.sql import functions as F

    return F.expr(parse.normalize_dialect(e))


def context_tokens(model: SemanticModel) -> tuple[int, int]:
    """(estimated tokens of the model with three samples a dimension, what is allowed)."""
    slim = from_yaml(to_yaml(model))
    services = 0
    for t in slim.tables:
        for c in t.fields():
            c.sample_values = c.sample_values[:SAMPLES]
            services += bool(c.search_service)
    slim.verified_queries = []
    return math.ceil(len(to_yaml(slim)) / CHARS_A_TOKEN), TOKENS - BASE_TOKENS - LITERAL_TOKENS * (1 + services)


def check_context(model: SemanticModel, throw: bool = False) -> str | None:
    used, most = context_tokens(model)
    if used <= most:
        return None
    text = f"the model has about {used} tokens; {most} are allowed"
    if throw:
        raise ModelError(text)
    return text


def validate(spark: SparkSession, text: str, sources: dict[str, DataFrame] | None = None, bind: bool = True) -> SemanticModel:
    """A valid model, or ModelError with all problems."""
    model = from_yaml(text)
    bad = problems(spark, model) or (binding_problems(spark, model, sources) if bind else [])
    if bad:
        raise ModelError("\n".join(bad))
    check_context(model, throw=True)
    return model
