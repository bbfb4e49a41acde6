"""Suggested filters of a table: recent rows, and the values of small domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..plans.model import NamedFilter
from ..sources.catalog import RawTable

DAYS = 30
#: Column -> all its values.
Domains = dict[str, list[str]]


def categorical_filter(c: str, kind: str, values: list[str]) -> NamedFilter | None:
    """``c IN (...)`` for two to five values of text, booleans, or numbers named as categories."""
    filled = sorted({v for v in values if not N.is_nullish(v)})
    family = N.type_family(kind)
    named = bool(set(N.identifier_tokens(c)[-1:]) & R.FILTER_SUFFIXES)
    if not 2 <= len(filled) <= 5 or not (family == "categorical" or (family == "numeric" and named)) or (N.key_stem(c)[1] in ("ID", "KEY")):
        return None
    if family == "categorical" and N.is_time_like(c, kind, filled):
        return None
    return NamedFilter(f"{c.lower()}_values", f"{c} IN ({', '.join(N.format_literal(v, kind) for v in filled)})", f"The values of {c}")


def recent_filter(c: str, days: int = DAYS) -> NamedFilter:
    return NamedFilter(f"{c.lower()}_last_{days}_days", f"{c} >= date_sub(current_date(), {days})", f"The last {days} days by {c}")


def suggest(t: RawTable, exact_values: dict[str, list[str]] | None = None) -> list[NamedFilter]:
    """``exact_values``: whole domains by column; without them the samples are taken for it."""
    out = []
    for c in t.columns:
        if N.is_time_like(c.name, c.data_type, c.values):
            out.append(recent_filter(c.name))
            continue
        values = c.values if exact_values is None else exact_values.get(c.name, [])
        if f := categorical_filter(c.name, c.data_type, [v for v in values if v is not None]):
            out.append(f)
    return out


def small_domains(df: DataFrame, most: int = 5, samples: Domains | None = None) -> Domains:
    """Columns with at most ``most`` distinct values, with all of them: a sketch first, exact sets for the few that may be.

    Columns of which ``samples`` has more values already aren't read at all.
    """
    from .profile import plain_columns

    cols = [c for c in plain_columns(df) if samples is None or len(set(samples.get(c, []))) <= most]
    if not cols:
        return {}
    near = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if near[c] <= 2 * most]
    if not few:
        return {}
    sets = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in few]).first()
    return {c: list(sets[c]) for c in few if len(sets[c]) <= most}


def last_days(df: DataFrame, ts: str, days: int = DAYS) -> DataFrame:
    """Rows of the last days before the newest one: anchored in the data, not at the clock.  The bound is a scalar subquery, which the scan can use."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {days} DAYS"))
