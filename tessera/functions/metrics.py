"""From words to aggregates."""

from __future__ import annotations

import re

from .names import base_type
from .rules import METRIC_PHRASES, METRIC_WORDS, NUMERIC


def metric_intent(text: str) -> str:
    """avg, count, count_distinct, product or sum, by whole words (``discounted`` doesn't count)."""
    low = text.lower()
    words = set(re.findall(r"[a-z]+", low))
    has = lambda kind: bool(words & METRIC_WORDS[kind]) or any(p in low for p in METRIC_PHRASES.get(kind, ()))
    if has("avg"):
        return "avg"
    if has("count"):
        return "count_distinct" if has("distinct") else "count"
    if has("product"):
        return "product"
    return "sum"


def metric_expression(intent: str, sources: list[tuple[str, str]]) -> str:
    """An aggregate over the sources (column, type); averages and sums of what isn't a number become counts."""
    if not sources:
        return "COUNT(*)"
    numbers = [c for c, t in sources if base_type(t) in NUMERIC]
    first = sources[0][0]
    if intent == "product" and len(numbers) >= 2:
        return f"SUM({' * '.join(numbers[:2])})"
    if intent == "count_distinct":
        return f"COUNT(DISTINCT {first})"
    if intent == "count" or not numbers:
        return f"COUNT({first})"
    return f"{'AVG' if intent == 'avg' else 'SUM'}({numbers[0]})"


def aggregation(kind: str, expr: str) -> str:
    """SQL of a default aggregation."""
    if kind == "count_distinct":
        return f"count(distinct {expr})"
    if kind not in ("sum", "avg", "median", "min", "max", "count"):
        raise ValueError(f"unknown aggregation {kind!r}")
    return f"{kind}({expr})"
