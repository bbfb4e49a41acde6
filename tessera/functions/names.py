"""Algebra of table and column names.

All of it works on names, of which there are thousands at most, and runs on the driver;
``similarity_column`` is the part that is useful as a column expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def identifier_tokens(name: str, drop: frozenset[str] = frozenset()) -> list[str]:
    """Upper-case tokens, split at other characters and at camel humps; a first token in ``drop`` goes."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    tokens = re.findall("[0-9A-Z]+", spaced.upper())
    return tokens[1:] if len(tokens) > 1 and tokens[0] in drop else tokens


def sanitize_identifier_name(name: str, prefixes: frozenset[str] = frozenset()) -> str:
    """Without a one-letter first part (``o_orderkey``) or a listed prefix."""
    tokens = identifier_tokens(name)
    if len(tokens) > 1 and (len(tokens[0]) == 1 or tokens[0] in prefixes):
        tokens = tokens[1:]
    return "_".join(tokens)


def normalize_identifier(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_$]", "_", name)).strip("_")


def is_valid_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", name))


def safe_semantic_identifier(raw: str, used: set[str], reserved: frozenset[str] = frozenset(), fallback: str = "field", drop: frozenset[str] = frozenset()) -> str:
    """A lower-case name that is neither reserved nor used (it is added to used): ``year`` -> ``year_2``."""
    base = "_".join(identifier_tokens(normalize_identifier(raw), drop)).lower() or fallback
    if base[0].isdigit():
        base = f"{fallback}_{base}"
    name, n = base, 2
    while name in used or name.upper() in reserved:
        name, n = f"{base}_{n}", n + 1
    used.add(name)
    return name


def singularize(token: str) -> str:
    t = token.upper()
    if t.endswith("IES") and len(t) > 4:
        return t[:-3] + "Y"
    if re.search("(SS|X|Z|[CS]H)ES$", t):
        return t[:-2]
    return t[:-1] if t.endswith("S") and not t.endswith(("SS", "US", "IS")) and len(t) > 3 else t


def clean_column_type(kind: str) -> str:
    return re.sub(r"\s+(NOT\s+)?NULL$", "", re.sub(r"\s+", " ", kind.strip().upper()))


def base_type(kind: str) -> str:
    cleaned = clean_column_type(kind)
    return re.split(r"[(\s<]", cleaned, maxsplit=1)[0] if cleaned else ""


def type_family(kind: str) -> str:
    """time, categorical, numeric, object or unknown."""
    b = base_type(kind)
    for family, names in (("time", R.TEMPORAL), ("categorical", R.CATEGORICAL), ("numeric", R.NUMERIC), ("object", R.OBJECTS)):
        if b in names:
            return family
    return "unknown"


def key_family(kind: str) -> str | None:
    """integer or string if columns of the type can be keys (decimals only with scale 0, NUMBER without one counts as an integer)."""
    b = base_type(kind)
    scale = re.search(r"\(\s*\d+\s*,\s*(\d+)\s*\)", kind)
    if b in R.INTEGERS or b == "LONG" or (b in ("NUMBER", "DECIMAL", "NUMERIC") and (scale is None and b == "NUMBER" or scale is not None and scale[1] == "0")):
        return "integer"
    return "string" if b in R.CATEGORICAL - {"BOOLEAN"} else None


def is_generic_identifier(name: str) -> bool:
    tokens = identifier_tokens(name)
    return bool(tokens) and set(tokens) <= R.GENERIC_TOKENS


def entity_tokens(table: str) -> list[str]:
    """The words of the entity that a table is about: without layer prefixes and describing suffixes, singular."""
    tokens = [singularize(t) for t in identifier_tokens(table)]
    while len(tokens) > 1 and tokens[0] in R.TABLE_PREFIXES:
        tokens = tokens[1:]
    while len(tokens) > 1 and tokens[-1] in R.TABLE_SUFFIXES:
        tokens = tokens[:-1]
    return tokens


def key_stem(column: str) -> tuple[str, str]:
    """(stem, key suffix) of a column: ``o_custkey`` -> (CUST, KEY), ``owner_user_id`` -> (OWNER_USER, ID), ``channel`` -> (CHANNEL, '')."""
    tokens = identifier_tokens(column)
    if len(tokens) > 1 and len(tokens[0]) <= 2 and tokens[0] not in ("ID",):
        tokens = tokens[1:]
    if tokens and tokens[-1] in R.KEY_SUFFIXES:
        return "_".join(tokens[:-1]), tokens[-1]
    for suffix in ("KEY", "ID", "NUMBER", "NUM"):
        last = tokens[-1] if tokens else ""
        if last.endswith(suffix) and len(last) > len(suffix):
            return "_".join([*tokens[:-1], last[: -len(suffix)]]), suffix
    return "_".join(tokens), ""


def expand(token: str) -> str:
    return R.ABBREVIATIONS.get(token, token)


def are_variants(a: str, b: str) -> bool:
    """Abbreviation, plural, prefix of three letters or more, or nearly the same."""
    a, b = singularize(a), singularize(b)
    if not a or not b:
        return False
    x, y = (expand(t) for t in (a, b))
    if x == y:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short) and "_" not in long:
        return True
    return 1 - levenshtein(x, y) / max(len(x), len(y)) > 0.85


def table_variants(table: str) -> set[str]:
    """Forms under which a column may mention the table."""
    tokens = entity_tokens(table)
    whole = "_".join(tokens)
    out = {whole, whole.replace("_", ""), *(t for t in tokens if len(t) >= 3), *(t[:n] for t in tokens for n in (3, 4) if len(t) > n), *(t[-4:] for t in tokens if len(t) > 4)}
    return {v for v in out if v} | {k for k, v in R.ABBREVIATIONS.items() if v in tokens}


def normalized_table_tokens(table: str) -> set[str]:
    return set(entity_tokens(table))


def normalized_column_tokens(column: str) -> set[str]:
    stem, _ = key_stem(column)
    return {singularize(t) for t in stem.split("_") if t and t not in R.GENERIC_TOKENS}


def column_mentions_table(column: str, table: str) -> bool:
    words, tokens = normalized_column_tokens(column), normalized_table_tokens(table)
    return bool(words & tokens) or any(are_variants(w, t) for w in words for t in tokens)


def table_prefixes(table: str) -> set[str]:
    tokens = identifier_tokens(table)
    first = tokens[0] if tokens else ""
    return {first, first[:1], first[:2], first[:3]} - {""} if first in R.TABLE_PREFIXES else set()


def global_prefixes(columns: list[str]) -> set[str]:
    """First tokens of at most three letters that two columns or more share."""
    from collections import Counter

    firsts = Counter(t[0] for t in map(identifier_tokens, columns) if len(t) > 1 and len(t[0]) <= 3)
    return {p for p, n in firsts.items() if n >= 2}


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def core_entity(name: str) -> str:
    """Lower case, without a prefix of up to two letters and one key suffix."""
    s = re.sub(r"^[a-z0-9]{1,2}_", "", name.lower())
    return re.sub(r"_?(key|id|num|no)$", "", s).strip("_") or s


def name_similarity(a: str, b: str) -> float:
    if a.lower() == b.lower():
        return 1.0
    x, y = core_entity(a), core_entity(b)
    if x and x == y:
        return 0.95
    squash = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    if squash(a) == squash(b):
        return 0.95
    if x and y and are_variants(x.upper(), y.upper()):
        return 0.90
    return round(1 - levenshtein(a.lower(), b.lower()) / max(len(a), len(b), 1), 6)


def core_entity_column(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "^[a-z0-9]{1,2}_", "")
    return F.regexp_replace(s, "_?(key|id|num|no)$", "")


def similarity_column(a: Column, b: Column) -> Column:
    """``name_similarity`` without the abbreviations, as a column."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(F.lower(a) == F.lower(b), 1.0)
        .when((core_entity_column(a) == core_entity_column(b)) & (core_entity_column(a) != ""), 0.95)
        .otherwise(F.round(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest, 6))
    )


def follows_fk_pattern(child: str, parent: str) -> bool:
    a, b = child.lower(), parent.lower()
    tail = lambda s: s.split("_", 1)[1] if "_" in s else s
    return tail(a) == tail(b) or (len(b) >= 4 and (a.endswith(b) or b in a)) or (len(a) >= 4 and a in b)


def is_entity_key_match(column: str, table: str) -> bool:
    stem, suffix = key_stem(column)
    entity = "_".join(entity_tokens(table))
    return bool(stem and suffix) and (stem == entity or entity.endswith("_" + stem) or are_variants(stem, entity) or are_variants(stem, entity.rsplit("_", 1)[-1]))


def is_identifier_like(column: str) -> bool:
    return bool(key_stem(column)[1]) or identifier_tokens(column)[-1:] == ["REFERENCE"]


def could_be_identifier(column: str, kind: str) -> bool:
    """By type and name: keys, never content or measures; an ``ID`` needs a stem or stands alone."""
    if key_family(kind) is None:
        return False
    tokens = identifier_tokens(column)
    return is_identifier_like(column) and not (set(tokens) & R.NOT_IDENTIFIERS - {"NUMBER", "DATE", "ADDRESS"})


def excluded_from_matching(column: str, kind: str) -> bool:
    """Timestamps, system times, content, enumeration and measure words are never keys, unless an ID or KEY says so."""
    family = type_family(kind)
    if family in ("time", "object") or key_family(kind) is None:
        return True
    tokens = set(identifier_tokens(column))
    if tokens & {"ID", "KEY", "UUID", "GUID", "CODE", "NO"} or key_stem(column)[1] in ("KEY", "ID"):
        return False
    if tokens & R.SYSTEM_ACTIONS and tokens & {"AT", "ON", "TIME"}:
        return True
    return bool(tokens & (R.CONTENT_WORDS | R.MEASURE_WORDS)) or (bool(tokens & R.TIME_WORDS) and key_family(kind) != "integer")


def is_join_key_candidate(column: str, kind: str, is_pk: bool = False) -> bool:
    if is_pk:
        return True
    if key_family(kind) is None or excluded_from_matching(column, kind):
        return False
    return is_identifier_like(column) or key_family(kind) == "integer"


def looks_like_primary_key(table: str, column: str) -> bool:
    tokens = identifier_tokens(column)
    name = "_".join(tokens)
    if name in ("ID", "PK", "KEY", "ROWID", "UUID", "GUID") or name in R.SURROGATES:
        return True
    return is_entity_key_match(column, table)


def looks_like_foreign_key(child_table: str, parent_table: str, column: str) -> bool:
    stem, suffix = key_stem(column)
    if "_".join(identifier_tokens(column)) in R.AUDIT_ACTORS and set(entity_tokens(parent_table)) & R.PERSON_TABLES:
        return True
    if not suffix:
        return False
    entity = "_".join(entity_tokens(parent_table))
    return bool(stem) and (is_entity_key_match(column, parent_table) or stem.endswith("_" + entity)) and "_".join(entity_tokens(child_table)) != stem


def is_noise_table(name: str) -> bool:
    return any(re.search(p, name, re.IGNORECASE) for p in R.NOISE_TABLES)


def to_snake_case(name: str) -> str:
    return re.sub(r"[\s\-./]+", "_", name.strip()).lower()


# ---- quoting


def strip_quotes(name: str) -> str:
    n = name.strip()
    if len(n) > 1 and n[0] == n[-1] and n[0] in "`\"":
        return n[1:-1].replace(n[0] * 2, n[0])
    return n


def quote_identifier(name: str) -> str:
    return "`" + strip_quotes(name).replace("`", "``") + "`"


def split_identifier(name: str) -> list[str]:
    """The parts of a dotted name; dots within quotes don't split."""
    return [strip_quotes(p) for p in re.findall(r"`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|[^.]+", name)]


def join_quoted(*parts: str | None) -> str:
    return ".".join(quote_identifier(p) for p in parts if p)


def sanitize_slug(name: str, used: set[str]) -> str:
    """A metric's name: a slug that isn't used, else with _2, _3, ..."""
    base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "metric"
    out, n = base, 2
    while out in used:
        out, n = f"{base}_{n}", n + 1
    used.add(out)
    return out


def sanitize_query_name(name: str, used: set[str]) -> str:
    base = re.sub(r"\s+", " ", name).strip() or "Query"
    out, n = base, 2
    while out in used:
        out, n = f"{base} ({n})", n + 1
    used.add(out)
    return out


ISO = re.compile(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")


def is_time_like(column: str, kind: str, samples: list[str] | None = None) -> bool:
    """A time type, or a string with dates as samples (and, without samples, a time word as a token)."""
    family = type_family(kind)
    if family == "time":
        return True
    if family != "categorical" or base_type(kind) == "BOOLEAN":
        return False
    values = [v for v in (samples or []) if not is_nullish(v)][:5]
    if values:
        return any(ISO.match(str(v).strip()) for v in values)
    return bool(set(identifier_tokens(column)) & R.TIME_WORDS)


def is_nullish(value) -> bool:
    return value is None or value != value or str(value).strip().upper() in R.NULLISH


def truthy(value) -> bool:
    return value is True or str(value).strip().upper() in ("TRUE", "YES", "Y", "1", "T")


def format_literal(value: str, kind: str) -> str:
    """SQL text of a sample value."""
    if type_family(kind) == "numeric":
        try:
            float(value)
            return str(value).strip()
        except ValueError:
            pass
    if base_type(kind) == "BOOLEAN":
        return "TRUE" if truthy(value) else "FALSE"
    return "'" + str(value).replace("'", "''") + "'"
