"""Relationship discovery: keys, edges, cardinalities, join types, confidences, bridges.

Names propose, data decide.  Name logic is on the driver, proportional to the number of columns; with
DataFrames, all name-gated candidates are then checked against whole tables by one Spark job
of joins over distinct keys (``inclusion``).  Value inclusion alone never makes an edge: small
dense integers are contained in every surrogate key.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..plans.model import RelationKey, Relationship
from ..sources.catalog import RawColumn, RawTable, tables_from_definitions, tables_from_frames, tables_from_metadata, type_name
from . import confidence as C
from .inclusion import ColumnProfile, cannot_reach, composite_uniqueness, inclusions
from .profile import profile

GENERIC = "generic key of the entity"
BANDS = ((0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low"))


@dataclass(frozen=True)
class Key:
    table: str
    columns: tuple[str, ...]
    source: str  # declared, name, initial, sample


@dataclass
class Edge:
    left: str
    right: str
    keys: list[tuple[str, str]]
    score: float
    reasons: list[str] = field(default_factory=list)
    cardinality: str = "many_to_one"
    join_type: str = "inner"
    via: str = ""
    role: str = ""
    evidence: dict | None = None
    factors: C.Confidence | None = None
    boosts: C.Confidence | None = None
    bridge_keys: tuple[str, str] = ("", "")  # of a bridge edge: the keys of left and right

    @property
    def confidence(self) -> float:
        """The factors and the boosts of domain knowledge; of bridges and self references the score."""
        return self.base_confidence if self.boosts is None else round(min(1.0, self.base_confidence + self.boosts.total), 4)

    @property
    def base_confidence(self) -> float:
        return round(min(1.0, self.score), 4) if self.factors is None else self.factors.value

    @property
    def all_factors(self) -> list[tuple[str, float, str]]:
        return [x for c in (self.factors, self.boosts) if c for x in c.factors]

    @property
    def is_self(self) -> bool:
        return self.left == self.right

    @property
    def name(self) -> str:
        base = f"{self.left}_to_{self.right}".lower()
        if self.via:
            return f"{self.left}_{self.right}_via_{self.via}".lower()
        return f"{base}_{self.role.lower()}" if self.role else base


@dataclass
class Discovery:
    edges: list[Edge]
    tables: list[str]
    missed: list[dict]
    primary_keys: dict[str, Key]
    milliseconds: int = 0
    limited_by_tables: bool = False
    limited_by_relationships: bool = False
    timed_out: bool = False
    notes: list[str] = field(default_factory=list)

    @property
    def confidence_by_name(self) -> dict[str, float]:
        return {e.name: e.confidence for e in self.edges}

    def summary(self) -> dict:
        return {
            "tables": len(self.tables), "relationships": len(self.edges), "missed_candidates": len(self.missed), "processing_ms": self.milliseconds,
            "limited_by_tables": self.limited_by_tables, "limited_by_relationships": self.limited_by_relationships, "timed_out": self.timed_out, "notes": self.notes,
        }

    def detailed(self) -> dict:
        """Plain data for JSON or YAML, with the SQL of each join."""
        edges = [{"name": e.name, "left_table": e.left, "right_table": e.right, "keys": [list(k) for k in e.keys], "type": e.cardinality, "join": e.join_type, "via": e.via, "confidence": e.confidence, "band": band(e.confidence), "reasons": e.reasons, "factors": [list(f) for f in e.all_factors], "suggested_join_sql": join_sql(e)} for e in self.edges]
        return {"relationships": edges, "missed_candidates": self.missed, "primary_keys": {t: list(k.columns) for t, k in self.primary_keys.items()}, "summary": self.summary()}

    def missed_dataframe(self, spark: SparkSession) -> DataFrame:
        names = ("table", "column", "candidate_table", "candidate_column", "reason", "samples")
        return spark.createDataFrame([tuple(m[n] for n in names) for m in self.missed], "table string, column string, candidate_table string, candidate_column string, reason string, samples array<string>")

    def factors_dataframe(self, spark: SparkSession) -> DataFrame:
        """(name, factor, points, reason): what each edge's confidence is made of."""
        return spark.createDataFrame([(e.name, *f) for e in self.edges for f in e.all_factors], "name string, factor string, points double, reason string")

    def relationships(self) -> list[Relationship]:
        return [Relationship(e.name, e.left, e.right, [RelationKey(a, b) for a, b in e.keys], e.join_type, e.cardinality, e.via) for e in self.edges]

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.left, e.right, ",".join(a for a, _ in e.keys), ",".join(b for _, b in e.keys), e.cardinality, e.join_type, e.via, e.is_self, round(e.score, 4), e.confidence, band(e.confidence), e.reasons) for e in self.edges]
        return spark.createDataFrame(
            rows,
            "name string, left_table string, right_table string, left_columns string, right_columns string, relationship_type string, join_type string, via string, is_self boolean, score double, confidence double, band string, reasons array<string>",
        )


def band(confidence: float) -> str:
    return next((name for at, name in BANDS if confidence >= at), "very_low")


def join_sql(e: Edge) -> str:
    """``FROM ... JOIN ...`` text of an edge; over the bridge, where there is one."""
    q = N.quote_identifier
    if e.via:
        (a, b), via = e.keys[0], q(e.via)
        x, y = e.bridge_keys
        return f"FROM {via} JOIN {q(e.left)} ON {via}.{q(a)} = {q(e.left)}.{q(x)} JOIN {q(e.right)} ON {via}.{q(b)} = {q(e.right)}.{q(y)}"
    how = {"inner": "JOIN", "left_outer": "LEFT JOIN", "right_outer": "RIGHT JOIN", "full_outer": "FULL JOIN"}[e.join_type]
    right = "parent" if e.is_self else q(e.right)
    named = f"{q(e.right)} AS parent" if e.is_self else right
    return f"FROM {q(e.left)} {how} {named} ON " + " AND ".join(f"{q(e.left)}.{q(a)} = {right}.{q(b)}" for a, b in e.keys)


def evaluate(found: Discovery, golden: set[tuple[str, str]]) -> dict[str, float]:
    """Precision, recall and F1 of the direct edges against (child, parent) pairs."""
    got = {(e.left.lower(), e.right.lower()) for e in found.edges if not e.via}
    want = {(a.lower(), b.lower()) for a, b in golden}
    hit = len(got & want)
    p, r = hit / len(got) if got else 0.0, hit / len(want) if want else 0.0
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def sample_confidence(child: list[str], parent: list[str], least: int = 20) -> float:
    """From values alone: how unique the parent's are, how many of the child's it has, how much less unique the child's are."""
    a, b = [v for v in child if not N.is_nullish(v)], [v for v in parent if not N.is_nullish(v)]
    if len(a) < least or len(b) < least:
        return 0.0
    step = lambda x, cuts: next((s for at, s in cuts if x > at), 0.0)
    ua, ub = len(set(a)) / len(a), len(set(b)) / len(b)
    shared = len(set(a) & set(b)) / len(set(a))
    return round(step(ub, ((0.95, 0.4), (0.85, 0.3), (0.7, 0.15))) + step(shared, ((0.8, 0.5), (0.6, 0.35), (0.4, 0.2), (0.2, 0.1))) + step(ub - ua, ((0.3, 0.1), (0.1, 0.05))), 4)


# ---- keys


def _usable(c: RawColumn) -> bool:
    return N.key_family(c.data_type) is not None and not N.excluded_from_matching(c.name, c.data_type)


def primary_key(t: RawTable, others: list[RawTable]) -> Key | None:
    """Declared, else by name unless the values repeat, else unique values of an identifier that names no other table."""
    declared = tuple(c.name for c in t.columns if c.is_primary_key)
    if declared:
        return Key(t.name, declared, "declared")
    whole = "_".join(N.entity_tokens(t.name))
    named = [c for c in t.columns if N.key_family(c.data_type) and not set(N.identifier_tokens(c.name)) & R.SYSTEM_ACTIONS and N.looks_like_primary_key(t.name, c.name) and (c.uniqueness is None or c.uniqueness >= 0.9)]
    if named:
        best = max(named, key=lambda c: (N.key_stem(c.name)[0] == whole, N.key_stem(c.name)[1] in ("KEY", "ID"), -t.columns.index(c)))
        return Key(t.name, (best.name,), "name")
    for c in t.columns:
        stem, suffix = N.key_stem(c.name)
        if len(stem) == 1 and suffix in ("ID", "KEY") and whole.startswith(stem) and N.key_family(c.data_type):
            return Key(t.name, (c.name,), "initial")
    for c in t.columns:
        if _usable(c) and N.is_identifier_like(c.name) and c.uniqueness == 1.0 and len(set(c.values)) >= 20:
            if not any(N.column_mentions_table(c.name, o.name) for o in others if o.name != t.name):
                return Key(t.name, (c.name,), "sample")
    return None


# ---- scoring


def _samples(c: RawColumn) -> set[str]:
    return {v for v in c.values if not N.is_nullish(v)}


def score(child: RawTable, c: RawColumn, parent: RawTable, key: Key, child_key: Key | None) -> tuple[float, list[str]] | None:
    """Name evidence (with that of samples) that ``c`` refers to the parent's single key column; None: it doesn't."""
    p = parent.column(key.columns[0])
    if N.key_family(c.data_type) != N.key_family(p.data_type):
        return None
    stem, suffix = N.key_stem(c.name)
    p_stem, _ = N.key_stem(p.name)
    entity, own = "_".join(N.entity_tokens(parent.name)), "_".join(N.entity_tokens(child.name))
    same_name = c.name.lower() == p.name.lower()
    reasons: list[str] = []
    if child_key and child_key.columns == (c.name,):
        # two keys of the same entity: only from a table to one that extends it
        if not (p_stem and stem == p_stem and entity.startswith(own + "_")):
            return None
        reasons.append("extension")
    bare = N.is_generic_identifier(p.name) and not p_stem
    if bare:
        if not suffix or not stem or not (N.are_variants(stem, entity) or stem.endswith("_" + entity)):
            return None
        base, why = 0.55, GENERIC
    elif key.source == "initial":
        if not same_name or own.startswith(p_stem):
            return None
        a, b = _samples(c), _samples(p)
        if not a or not b or len(a & b) / len(a) < 0.5:
            return None
        base, why = 0.5, "same short key with shared values"
    elif stem and suffix and stem == p_stem:
        base, why = 0.75, "same stem"
    elif stem and suffix and p_stem and N.are_variants(stem, p_stem):
        base, why = 0.7, "variant stem"
    elif stem and suffix and p_stem and len(p_stem) > 1 and (stem.endswith("_" + p_stem) or ("_" in stem and N.are_variants(stem.rsplit("_", 1)[-1], p_stem))):
        base, why = 0.65, "role of the entity"
    elif stem and suffix and N.are_variants(stem, entity):
        base, why = 0.65, "names the table"
    elif same_name and not suffix and key.source == "declared" and not set(N.identifier_tokens(c.name)) & R.CONTENT_WORDS:
        base, why = 0.65, "same name as a declared key"
    elif N.identifier_tokens(c.name)[-1] in ("REFERENCE", "REF") and set(N.entity_tokens(parent.name)) <= set(N.entity_tokens(child.name)) and N.column_mentions_table(c.name, parent.name):
        base, why = 0.6, "reference to a table in the child's name"
    elif N.looks_like_foreign_key(child.name, parent.name, c.name) and "_".join(N.identifier_tokens(c.name)) in R.AUDIT_ACTORS:
        base, why = 0.5, "actor"
    else:
        return None
    reasons.append(why)
    sampled = sample_confidence(c.values, p.values)
    if not bare:
        base += C.pair_score(c.name, p.name, sampled)
        if p_stem and p_stem == entity:
            base += 0.1
            reasons.append("key named after its table")
        if key.source == "declared":
            base += 0.05
            reasons.append("declared key")
        if same_name:
            base += 0.05
    a, b = _samples(c), _samples(p)
    if a and b:
        share = len(a & b) / len(a)
        if not share and 3 <= len(a) < 50 and 3 <= len(b) < 50:
            return None
        base += 0.1 * share
        if share:
            reasons.append("shared values")
    return base, reasons


def table_role(t: RawTable, key: Key | None = None) -> str:
    """bridge, staging, fact, dimension or unknown: by name, else by the shares of identifiers and measures."""
    words = {N.singularize(x) for x in N.identifier_tokens(t.name)}
    for role, marks in R.ROLE_WORDS.items():
        if words & marks:
            return role
    n = len(t.columns)
    ids = sum(N.is_identifier_like(c.name) and N.key_family(c.data_type) is not None for c in t.columns)
    measures = sum(N.type_family(c.data_type) == "numeric" and not N.is_identifier_like(c.name) for c in t.columns)
    if n and ids / n > 0.6 and n <= 10 and ids >= 2:
        return "bridge"
    if n and measures / n > 0.2 and ids >= 2:
        return "fact"
    if n and key and len(key.columns) == 1 and measures / n < 0.1:
        return "dimension"
    return "unknown"


def join_type(child: RawTable, parent: RawTable, keys: list[tuple[str, str]], roles: dict[str, str], evidence: dict | None, strict: bool = False) -> str:
    """With data: left_outer if rows would be lost.  Without: by nullish samples, roles and words."""
    if evidence:
        return "left_outer" if evidence["null_rows"] or evidence["orphan_rows"] else "inner"
    seen = [v for a, _ in keys for v in child.column(a).values[:25]]
    if any(N.is_nullish(v) for v in seen):
        return "left_outer"
    if strict:
        return "inner"
    a, b = roles[child.name], roles[parent.name]
    if b == "dimension" and set(N.identifier_tokens(parent.name)) & R.OPTIONAL_WORDS:
        return "left_outer"
    if a == "dimension" and b == "dimension":
        return "left_outer"
    if "bridge" in (a, b):
        return "inner"
    if "staging" in (a, b) or set(N.identifier_tokens(keys[0][0])) & R.OPTIONAL_WORDS:
        return "left_outer"
    return "inner"


def cardinality(unique_child: bool, unique_parent: bool) -> str:
    return {(True, True): "one_to_one", (False, True): "many_to_one", (True, False): "one_to_many", (False, False): "many_to_many"}[unique_child, unique_parent]


def _uniqueness(e: Edge, child: RawTable, parent: RawTable) -> dict:
    """Uniqueness of both sides and from how many values: of whole tables, else of the samples of the first pair."""
    if ev := e.evidence:
        full = ev["rows_child"] - ev["null_rows"]
        return {"unique": (ev["ndv_child"] / full if full else 0.0, 1.0 if (ev["max_parent"] or 0) <= 1 else 0.0), "values": full}
    sides = [[v for v in t.column(c).values if not N.is_nullish(v)] for t, c in zip((child, parent), e.keys[0], strict=True)]
    if not all(sides):
        return {}
    return {"unique": tuple(len(set(v)) / len(v) for v in sides), "values": min(map(len, sides))}


# ---- bridges


def bridge_score(t: RawTable, fk_columns: int, parents: list[str]) -> float:
    n = len(t.columns)
    if n == 0 or fk_columns < 2:
        return 0.0
    ratio = fk_columns / n
    out = 0.4 if ratio >= 0.7 else 0.3 if ratio >= 0.5 else 0.2 if ratio >= 0.3 else 0.0
    out += 0.3 if n <= 4 else 0.2 if n <= 6 else 0.1 if n <= 8 else 0.0
    plain = sum(not N.is_identifier_like(c.name) for c in t.columns)
    out += 0.2 if plain == 0 else 0.1 if plain == 1 else 0.0
    out += 0.1
    words = {N.singularize(x) for x in N.identifier_tokens(t.name)}
    out += 0.2 if words & R.ROLE_WORDS["bridge"] else 0.0
    out += 0.15 if sum(bool(words & set(N.entity_tokens(p))) for p in parents) >= 2 else 0.0
    if n <= 3 and fk_columns >= 2:
        out = max(out, 0.85)
    return round(min(out, 1.0), 4)


# ---- the whole


def discover(
    tables: list[RawTable],
    *,
    frames: dict[str, DataFrame] | None = None,
    min_confidence: float = 0.5,
    max_relationships: int | None = None,
    max_tables: int | None = None,
    timeout_seconds: float | None = None,
    strict: bool = False,
    keep_noise: bool = False,
    prefilter: bool = False,
) -> Discovery:
    """All relationships among the tables; ``frames`` (by table name) add exact evidence."""
    began = time.monotonic()
    out = Discovery([], [], [], {})
    late = lambda: timeout_seconds is not None and time.monotonic() - began > timeout_seconds
    ordered = sorted(tables, key=lambda t: t.name)
    if max_tables is not None and len(tables) > max_tables:
        kept = {t.name for t in tables[:max_tables]}
        ordered, out.limited_by_tables = [t for t in ordered if t.name in kept], True
        out.notes.append(f"only the first {max_tables} tables")
    out.tables = [t.name for t in ordered]
    if prefilter:
        ordered = [key_prefilter(t) for t in ordered]
    work = [t for t in ordered if keep_noise or not N.is_noise_table(t.name)]
    by_name = {t.name: t for t in work}
    keys = {t.name: k for t in work if (k := primary_key(t, work))}
    roles = {t.name: table_role(t, keys.get(t.name)) for t in work}
    edges: list[Edge] = []
    for t in work:
        if late():
            out.timed_out = True
            break
        for c in t.columns:
            if not _usable(c):
                continue
            found = []
            for parent in work:
                key = keys.get(parent.name)
                if parent.name == t.name or not key or len(key.columns) != 1:
                    continue
                if got := score(t, c, parent, key, keys.get(t.name)):
                    found.append((got[0], parent.name, key.columns[0], got[1]))
            best = max((f[0] for f in found), default=0.0)
            for s, parent, column, reasons in sorted(found, key=lambda f: (-f[0], f[1])):
                if s >= best - 1e-9 or sample_confidence(c.values, by_name[parent].column(column).values) > 0.8 or (frames and s >= 0.6):
                    edges.append(Edge(t.name, parent, [(c.name, column)], s, reasons))
            if not found and N.is_identifier_like(c.name) and not c.is_primary_key:
                out.missed += _near_misses(t, c, work, keys)
        edges += _composites(t, work, keys, frames)
        edges += _self_edges(t, keys.get(t.name), out.missed, frames)
    edges = _settle(edges, keys)
    if frames and edges and not out.timed_out:
        left = None if timeout_seconds is None else timeout_seconds - (time.monotonic() - began)
        edges = _with_evidence(edges, frames, out, left)
    # with data, a lower-scored parent stays only if it holds every value
    top: dict[tuple[str, tuple], float] = {}
    for e in edges:
        at = (e.left, tuple(a for a, _ in e.keys))
        top[at] = max(top.get(at, 0.0), e.score)
    edges = [e for e in edges if e.score >= top[e.left, tuple(a for a, _ in e.keys)] - 1e-9]
    for e in edges:
        child, parent = by_name[e.left], by_name[e.right]
        mine = [keys[t].columns if t in keys else () for t in (e.left, e.right)]
        if e.evidence:
            e.cardinality = cardinality((e.evidence["max_child"] or 0) <= 1, (e.evidence["max_parent"] or 0) <= 1)
        elif len(e.keys) > 1:
            e.cardinality = C.composite_cardinality(e.keys, *mine) or "many_to_one"
        else:
            unique = mine[0] == (e.keys[0][0],) and keys[e.left].source != "initial"
            e.cardinality = cardinality(unique, True)
        e.join_type = join_type(child, parent, e.keys, roles, e.evidence, strict)
        if not e.is_self:
            both = roles[e.left], roles[e.right]
            e.factors = C.confidence(child, parent, e.keys, roles=both, keys=tuple(mine), cardinality=e.cardinality, aligned=True, **_uniqueness(e, child, parent))
            e.boosts = C.domain(child, parent, e.keys, both, tuple(mine))
            if GENERIC in e.reasons:  # a name that every table has tells little, however well the rest fits
                e.boosts.add("generic_key", min(0.0, 0.55 - e.factors.value - e.boosts.total), GENERIC)
    bridges = _bridges(work, edges)
    named: dict[tuple[str, str], int] = {}
    for e in edges:
        named[e.left, e.right] = named.get((e.left, e.right), 0) + 1
    for e in edges:
        if named[e.left, e.right] > 1:
            e.role = N.key_stem(e.keys[0][0])[0] or e.keys[0][0]
    everything = [e for e in edges + bridges if e.confidence >= min_confidence]
    everything.sort(key=lambda e: (-e.confidence, e.left, e.right, e.keys))
    if max_relationships is not None and len(everything) > max_relationships:
        everything, out.limited_by_relationships = everything[:max_relationships], True
    out.edges, out.primary_keys = everything, keys
    out.milliseconds = int((time.monotonic() - began) * 1000)
    return out


def _composites(t: RawTable, work: list[RawTable], keys: dict[str, Key], frames: dict[str, DataFrame] | None) -> list[Edge]:
    """Edges on all columns of a key of several: declared, or of a table without a key, two identifiers whose pairs are unique.

    Data decide about undeclared keys, where there are; without, a pair counts if one column names another table and the other one is a number within.
    """
    out = []
    mine = keys[t.name].columns if t.name in keys else ()
    like = lambda p, table: [c for c in t.columns if N.key_stem(c.name) == N.key_stem(p) and N.key_family(c.data_type) == N.key_family(table.column(p).data_type) is not None]
    for parent in work:
        if parent.name == t.name:
            continue
        key = keys.get(parent.name)
        declared = key is not None and len(key.columns) > 1
        weak = key is not None and key.source != "declared" and N.key_stem(key.columns[0])[1] in R.ORDINAL_SUFFIXES  # a number within something
        if key is not None and not declared and not weak:
            continue
        found = [sorted(key.columns)] if declared else undeclared_keys(parent, work)
        for columns in found:
            match = [like(p, parent) for p in columns]
            if any(len(m) != 1 for m in match):
                continue
            pairs = [(m[0].name, p) for m, p in zip(match, columns, strict=True)]
            child_key = mine
            if not C.composite_passes(pairs, child_key, tuple(columns)) or len({a for a, _ in pairs}) < len(pairs):
                continue
            if declared:
                if mine and mine != tuple(a for a, _ in pairs):
                    out.append(Edge(t.name, parent.name, pairs, 0.8, ["all columns of a composite key"]))
            elif mine and set(mine) != {a for a, _ in pairs}:
                if frames and (composite_uniqueness(frames[parent.name], list(columns)).first()["uniqueness"] or 0.0) < 1.0:
                    continue
                keys[parent.name] = Key(parent.name, tuple(columns), "composite")
                out.append(Edge(t.name, parent.name, pairs, 0.8, ["all columns of a composite key that isn't declared"]))
                break
    return out


def undeclared_keys(t: RawTable, work: list[RawTable]) -> list[list[str]]:
    """Pairs of identifiers that may be the key of a table without one: a reference to another table, and a number within it."""
    ids = [c for c in t.columns if _usable(c) and N.is_identifier_like(c.name)]
    refers = [c for c in ids if any(N.column_mentions_table(c.name, o.name) for o in work if o.name != t.name)]
    numbers = [c for c in t.columns if N.key_family(c.data_type) == "integer" and N.key_stem(c.name)[1] in R.ORDINAL_SUFFIXES and c not in refers]
    return [sorted((a.name, b.name)) for a in refers for b in numbers]


def _self_edges(t: RawTable, key: Key | None, missed: list[dict], frames: dict[str, DataFrame] | None) -> list[Edge]:
    """References of a table to itself, by name; values prove them: of samples, or of the whole table later on."""
    if not key or len(key.columns) != 1:
        return []
    p = t.column(key.columns[0])
    for c in t.columns:
        name = "_".join(N.identifier_tokens(c.name))
        if c.name == p.name or N.key_family(c.data_type) != N.key_family(p.data_type) or not any(w in name for w in R.SELF_REFERENCE):
            continue
        a, b = _samples(c), _samples(p)
        if frames and t.name in frames or a and b and len(a & b) / len(a) >= 0.5:
            return [Edge(t.name, t.name, [(c.name, p.name)], 0.85, ["self reference with shared values"], join_type="left_outer", role=name)]
        missed.append({"table": t.name, "column": c.name, "candidate_table": t.name, "candidate_column": p.name, "reason": "a self reference without values to prove it", "samples": c.values[:10]})
    return []


def _settle(edges: list[Edge], keys: dict[str, Key]) -> list[Edge]:
    """Edges point to the side whose key they use; of the same columns in both directions one stays, and of equal edges one."""
    of = lambda t: keys[t].columns if t in keys else ()
    seen: dict[tuple, Edge] = {}
    for e in sorted(edges, key=lambda e: (-e.score, e.left, e.right, e.keys)):
        if not e.is_self and C.reversed_better(e.left, e.right, e.keys, of(e.left), of(e.right)):
            e = replace(e, left=e.right, right=e.left, keys=[(b, a) for a, b in e.keys])
        forth = (e.left, e.right, tuple(sorted((a.upper(), b.upper()) for a, b in e.keys)))
        back = (e.right, e.left, tuple(sorted((b.upper(), a.upper()) for a, b in e.keys)))
        if forth not in seen and (e.is_self or back not in seen):
            seen[forth] = e
    kept = {id(e) for e in seen.values()}
    same = [e for e in edges if id(e) in kept]
    return same + [e for e in seen.values() if all(e is not x for x in same)]


def _near_misses(t: RawTable, c: RawColumn, work: list[RawTable], keys: dict[str, Key]) -> list[dict]:
    out = []
    for parent in work:
        key = keys.get(parent.name)
        if parent.name != t.name and key and N.name_similarity(c.name, key.columns[0]) >= 0.9:
            samples = [*c.values[:10], *parent.column(key.columns[0]).values[:10]]
            out.append({"table": t.name, "column": c.name, "candidate_table": parent.name, "candidate_column": key.columns[0], "reason": "similar names, but not accepted", "samples": samples})
    key = keys.get(t.name)
    if not out and key and len(key.columns) == 1 and key.columns[0] != c.name and N.base_type(t.column(key.columns[0]).data_type) == N.base_type(c.data_type) and len(N.core_entity(c.name)) >= 3 and N.core_entity(c.name) != N.core_entity(key.columns[0]):
        samples = [*c.values[:10], *t.column(key.columns[0]).values[:10]]
        out.append({"table": t.name, "column": c.name, "candidate_table": t.name, "candidate_column": key.columns[0], "reason": "no other table's key fits; it may refer to its own table", "samples": samples})
    return out


def _bridges(work: list[RawTable], edges: list[Edge]) -> list[Edge]:
    out = []
    for t in work:
        mine = [e for e in edges if e.left == t.name and not e.is_self and e.score >= 0.5 and len(e.keys) == 1]
        parents = sorted({e.right for e in mine})
        s = bridge_score(t, len({e.keys[0][0] for e in mine}), parents)
        if len(parents) < 2 or s < 0.6:
            continue
        for i, a in enumerate(parents):
            for b in parents[i + 1 :]:
                left, right = (next(e for e in mine if e.right == x) for x in (a, b))
                keys = [(left.keys[0][0], right.keys[0][0])]
                out.append(Edge(a, b, keys, min(s, 0.85), [f"both referred to by {t.name}"], "many_to_many", "inner", t.name, bridge_keys=(left.keys[0][1], right.keys[0][1])))
    return out


#: With more candidates than so many, profiles of their columns discard those that can't be, before keys are counted.
PRUNE_FROM = 64


def _pruned(edges: list[Edge], frames: dict[str, DataFrame]) -> list[Edge]:
    """Without the single-column edges that counts and ranges rule out: one pass of sketches over each table, no shuffle of values."""
    wanted: dict[str, set[str]] = {}
    for e in edges:
        if len(e.keys) == 1 and e.left in frames and e.right in frames:
            wanted.setdefault(e.left, set()).add(e.keys[0][0])
            wanted.setdefault(e.right, set()).add(e.keys[0][1])
    plan = [profile(frames[t], sorted(cols), exact=False).select(F.lit(t).alias("t"), "*") for t, cols in wanted.items()]
    family = {t: {f.name: N.key_family(type_name(f.dataType)) or "" for f in frames[t].schema.fields} for t in wanted}
    known = {(r["t"], r["column_name"]): ColumnProfile(family[r["t"]][r["column_name"]], r["row_count"], r["ndv"], r["non_null"], r["min_value"], r["max_value"]) for r in reduce(DataFrame.unionByName, plan).collect()} if plan else {}
    out = []
    for e in edges:
        a, b = known.get((e.left, e.keys[0][0])), known.get((e.right, e.keys[0][1]))
        if len(e.keys) > 1 or a is None or b is None or not cannot_reach(a, b):
            out.append(e)
    return out


def _with_evidence(edges: list[Edge], frames: dict[str, DataFrame], out: Discovery, seconds: float | None = None) -> list[Edge]:
    """Checks all edges against whole tables in one job; drops those whose parent isn't unique or has few of the values.  The job is cancelled after ``seconds``."""
    if len(edges) > PRUNE_FROM:
        edges = _pruned(edges, frames)
    checked = [e for e in edges if e.left in frames and e.right in frames]
    found: dict[int, dict] = {}
    if checked:
        plan = inclusions([(frames[e.left], [a for a, _ in e.keys], frames[e.right], [b for _, b in e.keys]) for e in checked])
        rows = collect_within(plan, seconds)
        if rows is None:
            out.timed_out = True
            out.notes.append("stopped before all edges were checked against the tables")
            return edges
        found = {id(checked[r["edge"]]): r.asDict() for r in rows}
    kept = []
    for e in edges:
        ev = found.get(id(e))
        if ev is None or not ev["ndv_child"] or not ev["ndv_parent"]:
            if not e.is_self:
                kept.append(e)
            continue
        share = ev["coverage"] or 0.0
        if share < 0.5 or (ev["max_parent"] or 0) > 1 and len(e.keys) == 1 and not any("declared" in r for r in e.reasons):
            out.missed.append({"table": e.left, "column": e.keys[0][0], "candidate_table": e.right, "candidate_column": e.keys[0][1], "reason": f"{share:.0%} of the values are in the parent; the parent's key is {'not ' if ev['max_parent'] > 1 else ''}unique", "samples": []})
            continue
        kept.append(replace(e, score=e.score + 0.1 * share, evidence=ev, reasons=[*e.reasons, "checked on whole tables"]))
    return kept


def collect_within(df: DataFrame, seconds: float | None) -> list | None:
    """The rows, or None if they take longer: the job is cancelled then."""
    if seconds is None:
        return df.collect()
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late
    from uuid import uuid4

    from pyspark import inheritable_thread_target

    tag, sc = f"tessera-{uuid4().hex}", df.sparkSession.sparkContext

    def work() -> list:
        sc.addJobTag(tag)
        return df.collect()

    with ThreadPoolExecutor(1) as pool:
        job = pool.submit(inheritable_thread_target(df.sparkSession)(work))
        try:
            return job.result(timeout=max(seconds, 0.0))
        except Late:
            sc.cancelJobsWithTag(tag)
            job.exception()
            return None


# ---- entry points


def discover_from_definitions(definitions: list[dict], *, min_confidence: float = 0.5, timeout_seconds: float = 15, **more) -> Discovery:
    return discover(tables_from_definitions(definitions), min_confidence=min_confidence, timeout_seconds=timeout_seconds, **more)


def discover_from_metadata(meta: DataFrame, *, min_confidence: float = 0.5, timeout_seconds: float = 30, max_tables: int | None = None, **more) -> Discovery:
    return discover(tables_from_metadata(meta), min_confidence=min_confidence, timeout_seconds=timeout_seconds, max_tables=max_tables, **more)


def discover_from_frames(frames: dict[str, DataFrame], primary_keys: dict[str, list[str]] | None = None, **more) -> Discovery:
    """From DataFrames: names from the schemas, evidence from the data."""
    return discover(tables_from_frames(frames, primary_keys), frames=frames, **more)


def key_prefilter(t: RawTable) -> RawTable:
    """Only columns that can be keys; a table never loses all of them."""
    kept = [c for c in t.columns if N.is_join_key_candidate(c.name, c.data_type, c.is_primary_key)]
    return replace(t, columns=kept or t.columns)
