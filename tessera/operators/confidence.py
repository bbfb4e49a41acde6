"""How sure a relationship is: scores of column pairs, factors of confidence, domain knowledge, composite keys.

All of it works on names, roles and a few numbers about each edge, on the driver.  Every factor keeps its points and its reason, so
that a confidence can be shown as the sum that it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import names as N
from ..functions import rules as R
from ..sources.catalog import RawTable

Pairs = list[tuple[str, str]]


@dataclass
class Confidence:
    factors: list[tuple[str, float, str]] = field(default_factory=list)  # (factor, points, reason)

    @property
    def total(self) -> float:
        return sum(p for _, p, _ in self.factors)

    @property
    def value(self) -> float:
        return round(min(1.0, max(0.0, self.total)), 4)

    def add(self, factor: str, points: float, reason: str) -> None:
        if points:
            self.factors.append((factor, round(points, 4), reason))


def step(x: float, cuts: tuple[tuple[float, float], ...], otherwise: float = 0.0) -> float:
    """The points of the first cut that x reaches."""
    return next((points for at, points in cuts if x >= at), otherwise)


# ---- a pair of columns


def related_entities(a: str, b: str) -> bool:
    """Equal, one within the other at an end, or variants; entities of one letter tell nothing and pass."""
    if len(a) < 2 or len(b) < 2 or a == b:
        return True
    return a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a) or N.are_variants(a.upper(), b.upper())


def pair_score(child: str, parent: str, sampled: float = 0.0) -> float:
    """Similarity of the names, plus that of the entities, the naming pattern, and the evidence of samples (0 to 1)."""
    a, b = N.core_entity(child), N.core_entity(parent)
    entity = 0.0
    if a and b:
        entity = 0.5 if a == b else 0.3 if N.are_variants(a.upper(), b.upper()) or a.endswith(b) or b.endswith(a) else 0.0
    return round(N.name_similarity(child, parent) + entity + 0.1 * N.follows_fk_pattern(child, parent) + 0.6 * sampled, 6)


def least_score(child: str, parent: str, sampled: float = 0.0, usual: float = 0.6) -> float:
    """What ``pair_score`` must reach: less where entities agree or samples are strong."""
    a, b = N.core_entity(child), N.core_entity(parent)
    return 0.3 if a and b and (a.endswith(b) or b.endswith(a)) or sampled > 0.6 else usual


# ---- roles


def context(child_role: str, parent_role: str) -> str:
    """What kind of relationship the roles of two tables make."""
    both = (child_role, parent_role)
    if both in (("fact", "dimension"), ("dimension", "fact")):
        return "_to_".join(both)
    if "bridge" in both:
        return "bridge_relationship"
    if both == ("dimension", "dimension"):
        return "dimension_hierarchy"
    if both == ("fact", "fact"):
        return "fact_to_fact"
    return "staging_relationship" if "staging" in both else "unknown_relationship"


CONTEXT_POINTS = {"fact_to_dimension": 0.15, "dimension_to_fact": 0.15, "dimension_hierarchy": 0.1, "bridge_relationship": 0.1, "fact_to_fact": 0.05}


# ---- composite keys


def consistent(pairs: Pairs) -> bool:
    """No column of a side stands for two columns of the other."""
    return all(len({p[side].lower() for p in pairs}) == len({(a.lower(), b.lower()) for a, b in pairs}) for side in (0, 1))


@dataclass(frozen=True)
class KeyUse:
    """How the columns of one side of a relationship cover the table's key."""

    hits: int
    of: int
    identifiers: int

    @property
    def coverage(self) -> float:
        return self.hits / self.of if self.of else 0.0

    @property
    def whole_composite(self) -> bool:
        return self.hits > 1 and self.hits == self.of

    @property
    def partial(self) -> bool:
        return 0 < self.hits < self.of


def key_use(columns: list[str], key: tuple[str, ...]) -> KeyUse:
    low = {k.lower() for k in key}
    return KeyUse(sum(c.lower() in low for c in columns), len(low), sum(N.is_identifier_like(c) for c in columns))


def composite_passes(pairs: Pairs, child_key: tuple[str, ...], parent_key: tuple[str, ...]) -> bool:
    """Two pairs must cover 0.3 of a side's key, more of them a whole composite key; mappings must be consistent."""
    if len(pairs) < 2:
        return True
    a, b = key_use([x for x, _ in pairs], child_key), key_use([y for _, y in pairs], parent_key)
    if not consistent(pairs):
        return False
    return a.whole_composite or b.whole_composite if len(pairs) > 2 else max(a.coverage, b.coverage) >= 0.3


def composite_cardinality(pairs: Pairs, child_key: tuple[str, ...], parent_key: tuple[str, ...], unique: tuple[float, float] | None = None) -> str | None:
    """By whole keys, coverage of 0.8, or the uniqueness of tuples (child, parent) above 0.9; None if none of it tells."""
    a, b = key_use([x for x, _ in pairs], child_key), key_use([y for _, y in pairs], parent_key)
    for one, two in ((b.whole_composite, a.whole_composite), (b.coverage >= 0.8, a.coverage >= 0.8), (unique is not None and unique[1] > 0.9, unique is not None and unique[0] > 0.9)):
        if one or two:
            return "many_to_one" if one else "one_to_many"
    return None


def reversed_better(child: str, parent: str, pairs: Pairs, child_key: tuple[str, ...], parent_key: tuple[str, ...]) -> bool:
    """Whether the relationship should point the other way: the referring side has more of its own key, or is a dimension by name beside a fact or bridge."""
    a, b = key_use([x for x, _ in pairs], child_key).hits, key_use([y for _, y in pairs], parent_key).hits
    return a > b or (a == b and naming_convention(child) == "dimension" and naming_convention(parent) in ("fact", "bridge"))


# ---- domain knowledge


def business_entity(table: str, key: tuple[str, ...] = ()) -> str | None:
    """customer, product, order, date, location or employee: by words in the name of the table, else of its key."""
    name, keys = table.upper(), [k.upper().replace("_", "") for k in key]
    for entity, (tables, columns) in R.BUSINESS_ENTITIES.items():
        if any(w in name for w in tables) or any(c.replace("_", "") in k for c in columns for k in keys):
            return entity
    return None


def naming_convention(table: str) -> str | None:
    """fact, dimension, bridge or staging, by the parts that warehouses put into names."""
    name = table.upper()
    return next((kind for kind, parts in R.CONVENTIONS.items() if any(p in name for p in parts)), None)


def usual_fk(child: str, parent: str) -> str | None:
    """The kind of reference that a column of the pair is usually named for."""
    a, b = child.upper(), parent.upper()
    return next((kind for kind, columns in R.USUAL_FKS.items() if any(c in a or c in b for c in columns)), None)


def is_time_dimension(table: RawTable) -> bool:
    if any(w in table.name.upper() for w in R.BUSINESS_ENTITIES["date"][0]):
        return True
    named = sum(any(w in c.name.upper() for w in R.CALENDAR_WORDS) for c in table.columns)
    return bool(table.columns) and named / len(table.columns) > 0.3


def schema_pattern(child: RawTable, parent: RawTable, child_role: str, parent_role: str) -> str | None:
    both = {child_role, parent_role}
    if both == {"fact", "dimension"}:
        return "star"
    if both == {"dimension"}:
        return "snowflake"
    if is_time_dimension(parent) or is_time_dimension(child):
        return "time"
    return "bridge" if "bridge" in both else None


def domain(child: RawTable, parent: RawTable, pairs: Pairs, roles: tuple[str, str], keys: tuple[tuple[str, ...], tuple[str, ...]]) -> Confidence:
    """The boosts of domain knowledge."""
    out = Confidence()
    ends = business_entity(child.name, keys[0]), business_entity(parent.name, keys[1])
    for pair in (ends, ends[::-1]):
        if boost := R.ENTITY_PAIRS.get(pair):
            out.add("business_pair", boost, f"{pair[0]} and {pair[1]} usually refer to each other")
            break
    for a, b in pairs:
        if kind := usual_fk(a, b):
            out.add("usual_fk", 0.15, f"{a} is a usual name for a reference to a {kind}")
    kinds = naming_convention(child.name), naming_convention(parent.name)
    if set(kinds) == {"fact", "dimension"}:
        out.add("convention", 0.2, "names of a fact and a dimension")
    elif kinds == ("dimension", "dimension"):
        out.add("convention", 0.2, "names of two dimensions")
    if any(N.column_mentions_table(a, parent.name) for a, _ in pairs):
        out.add("mentions", 0.1, "a column mentions the table it refers to")
    if is_time_dimension(parent):
        out.add("time_dimension", 0.2, f"{parent.name} is a calendar")
    if pattern := schema_pattern(child, parent, *roles):
        out.add("schema_pattern", R.PATTERN_POINTS[pattern], f"{pattern} schema")
    return out


# ---- the whole


def confidence(
    child: RawTable,
    parent: RawTable,
    pairs: Pairs,
    *,
    roles: tuple[str, str],
    keys: tuple[tuple[str, ...], tuple[str, ...]],
    cardinality: str = "many_to_one",
    unique: tuple[float, float] | None = None,
    values: int = 0,
    threshold: float = 0.95,
    aligned: bool | None = None,
) -> Confidence:
    """Factors of a relationship's confidence.

    ``unique``: uniqueness of the columns of both sides, from ``values`` of them (of a sample, or all); ``aligned``: known from elsewhere that the columns name
    what they refer to.
    """
    out = Confidence()
    own = [bool(k) and key_use([p[side] for p in pairs], k).coverage == 1.0 for side, k in enumerate(keys)]
    if any(own):
        out.add("key", 0.3, "both sides are keys" if all(own) else "the parent's side is a key" if own[1] else "the child's side is a key")
    similar = sum(N.name_similarity(a, b) for a, b in pairs) / len(pairs)
    out.add("name", step(similar, ((0.9, 0.35), (0.7, 0.25), (0.5, 0.2), (0.3, 0.1)), 0.05), f"similarity of the names {similar:.2f}")
    generic = sum(N.is_generic_identifier(a) and N.is_generic_identifier(b) for a, b in pairs)
    out.add("generic", -min(out.total, 0.15 * generic, 0.3), "generic names on both sides")
    out.add("fk_pattern", min(0.2, 0.1 * sum(N.looks_like_foreign_key(child.name, parent.name, a) for a, _ in pairs)), "named like a foreign key")
    naming = [N.column_mentions_table(a, parent.name) or a.lower() == b.lower() for a, b in pairs]
    if aligned or all(naming):
        out.add("aligned", min(0.15, 0.05 * len(pairs)), f"names {parent.name}")
    else:
        out.add("misaligned", min(0.0, 0.15 - out.total), f"a column doesn't name {parent.name}")
    if unique is not None and values >= 20:
        single = cardinality.split("_to_")
        fits = all((u > threshold) == (s == "one") for u, s in zip(unique, single, strict=True))
        out.add("uniqueness", 0.2 if fits else 0.1, "uniqueness supports the cardinality" if fits else "uniqueness supports the cardinality in part")
    types = sum(N.base_type(child.column(a).data_type) == N.base_type(parent.column(b).data_type) for a, b in pairs) / len(pairs)
    out.add("type", step(types, ((1.0, 0.1), (0.8, 0.08), (0.5, 0.05))), f"{types:.0%} of the types are equal")
    if any(a.lower() == b.lower() for a, b in pairs):
        out.add("identical", 0.1, "the same name on both sides")
    kind = context(*roles)
    out.add("role", CONTEXT_POINTS.get(kind, 0.0), kind)
    if len(pairs) > 1:
        out.add("composite", 0.05, f"{len(pairs)} columns")
        if not consistent(pairs):
            out.add("inconsistent", max(-0.5, min(0.0, 0.1 - out.total)), "a column stands for several")
    if out.total > 1:
        out.add("limit", 1 - out.total, "at most 1")
    return out
