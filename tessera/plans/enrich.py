"""Descriptions, metrics and verified queries from a client that answers prompts with JSON.

A client is anything with ``complete(prompt) -> str``.  Only placeholders are filled; every metric must bind and
every verified query must run, or it is dropped.  A stage that fails leaves the others alone.
"""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..functions.metrics import metric_expression, metric_intent
from ..functions.names import sanitize_query_name, sanitize_slug
from . import logical, parse
from .model import Metric, SemanticModel, Table, VerifiedQuery

log = logging.getLogger(__name__)
STAGES = {"prepare": 5, "tables": 70, "summary": 5, "metrics": 10, "queries": 10}
MAX_METRICS, MAX_QUERIES, LIMIT = 5, 3, 200
PLACEHOLDERS = ("", "__", " ")


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Scripted:
    """Answers in order; the last one repeats."""

    def __init__(self, answers: list[dict | str]):
        self.answers, self.prompts = answers, []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        a = self.answers[min(len(self.prompts), len(self.answers)) - 1]
        return a if isinstance(a, str) else json.dumps(a)


class Offline:
    """Deterministic answers from names alone."""

    def complete(self, prompt: str) -> str:
        ask = json.loads(prompt)
        words = lambda n: n.replace("_", " ")
        if ask["task"] == "table":
            return json.dumps({"table_description": f"Rows of {words(ask['table'])}.", "columns": [{"name": c["name"], "description": f"The {words(c['name'])} of {words(ask['table'])}."} for c in ask["columns"]]})
        if ask["task"] == "summary":
            return json.dumps({"model_description": "A model of " + ", ".join(words(t) for t in ask["tables"]) + "."})
        return "{}"


class Progress:
    def __init__(self, tell: Callable[[float, str], None] | None):
        self.tell, self.done, self.began = tell or (lambda share, stage: None), 0.0, time.monotonic()

    def stage(self, name: str, share: float = 1.0) -> None:
        before = 0
        for n, w in STAGES.items():
            if n == name:
                self.done = before + w * share
                break
            before += w
        self.tell(self.done / 100, name)


def parse_answer(text: str) -> dict:
    """The first JSON object in the text."""
    at = text.find("{")
    while at >= 0:
        try:
            return json.JSONDecoder().raw_decode(text[at:])[0]
        except ValueError:
            at = text.find("{", at + 1)
    return {}


def merge_synonyms(have: list[str], more: list[str]) -> list[str]:
    seen = {s.lower() for s in have}
    out = list(have)
    for s in more:
        s = str(s).strip()
        if s and s.lower() not in seen:
            seen.add(s.lower())
            out.append(s)
    return out


def table_prompt(t: Table, extra: str = "") -> str:
    cols = [{"name": c.name, "type": c.data_type, "samples": c.sample_values[:5]} for c in t.fields()]
    return json.dumps({"task": "table", "table": t.name, "description": t.description, "columns": cols, "filters": [f.expr for f in t.filters], "notes": extra})


def overview(model: SemanticModel) -> dict:
    return {
        "tables": [t.name for t in model.tables],
        "columns": {t.name: {c.name: c.sample_values[:3] for c in t.fields()[:5]} for t in model.tables},
        "metrics": {t.name: [m.name for m in t.metrics] for t in model.tables},
        "relationships": [[r.left_table, r.right_table] for r in model.relationships],
    }


def apply_table(t: Table, a: dict) -> None:
    if t.description.strip() in PLACEHOLDERS and a.get("table_description"):
        t.description = a["table_description"]
    for c in a.get("columns") or []:
        col = t.field(str(c.get("name", "")))
        if not col:
            continue
        if col.description.strip() in PLACEHOLDERS and c.get("description"):
            col.description = c["description"]
        col.synonyms = merge_synonyms(col.synonyms, c.get("synonyms") or [])
    for f in a.get("filters") or []:
        for mine in t.filters:
            if mine.name.lower() == str(f.get("name", "")).lower():
                if mine.description.strip() in PLACEHOLDERS and f.get("description"):
                    mine.description = f["description"]
                if f.get("synonyms"):
                    mine.synonyms = [str(s) for s in f["synonyms"]]
    used = {m.name for m in t.metrics} | {c.name for c in t.fields()}
    for m in a.get("business_metrics") or []:
        sources = [(c.expr, c.data_type) for n in m.get("source_columns") or [] if (c := t.field(str(n)))]
        expr = m.get("expr") or metric_expression(metric_intent(f"{m.get('name', '')} {m.get('description', '')}"), sources)
        t.metrics.append(Metric(sanitize_slug(str(m.get("name", "metric")), used), expr, str(m.get("description", "")), merge_synonyms([], m.get("synonyms") or [])))


def _binds(spark: SparkSession, model: SemanticModel, m: Metric, sources: dict[str, DataFrame]) -> bool:
    from .query import Planner, metric_of

    try:
        table, one = metric_of(SemanticModel(name="x", tables=model.tables, metrics=[m]), m.name)
        v = Planner(spark, model, sources)._view(table)
        return bool(v.selectExpr(f"{one.expr} AS x").schema)
    except Exception as e:  # noqa: BLE001
        log.info("metric %s is dropped: %s", m.name, e)
        return False


def enrich(spark: SparkSession, model: SemanticModel, client: Client, *, custom_prompt: str = "", sources: dict[str, DataFrame] | None = None, progress: Callable[[float, str], None] | None = None) -> SemanticModel:
    told, sources = Progress(progress), sources or {}
    told.stage("prepare")

    def ask(prompt: str) -> dict:
        try:
            return parse_answer(client.complete(prompt))
        except Exception as e:  # noqa: BLE001
            log.warning("no answer: %s", e)
            return {}

    summary = ""
    for i, t in enumerate(model.tables):
        a = ask(table_prompt(t, custom_prompt))
        apply_table(t, a)
        summary = summary or a.get("model_description", "")
        told.stage("tables", (i + 1) / len(model.tables))
    if model.description.strip() in PLACEHOLDERS:
        model.description = summary or ask(json.dumps({"task": "summary", **overview(model)})).get("model_description", model.description)
    told.stage("summary")
    if any(t.facts or t.measures for t in model.tables):
        used = {m.name for m in model.metrics}
        for m in (ask(json.dumps({"task": "metrics", **overview(model)})).get("model_metrics") or [])[:MAX_METRICS]:
            metric = Metric(sanitize_slug(str(m.get("name", "metric")), used), str(m.get("expr", "")), str(m.get("description", "")))
            if metric.expr and _binds(spark, model, metric, sources):
                model.metrics.append(metric)
    told.stage("metrics")
    logical.register_views(spark, model, sources) if sources else None
    names = {q.name for q in model.verified_queries}
    for q in (ask(json.dumps({"task": "queries", **overview(model)})).get("verified_queries") or [])[:MAX_QUERIES]:
        sql = logical.ensure_limit(parse.normalize_dialect(str(q.get("sql", ""))), LIMIT)
        try:
            spark.sql(sql).limit(LIMIT).collect()
        except Exception as e:  # noqa: BLE001
            log.info("query %s is dropped: %s", q.get("name"), e)
            continue
        model.verified_queries.append(VerifiedQuery(sanitize_query_name(str(q.get("name", "Query")), names), str(q.get("question", "")), sql, int(time.time()), "enrichment"))
    told.stage("queries")
    return model


def normalize_answer_text(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
