"""The semantic model: logical tables with typed columns, metrics, filters, relationships and verified queries.

YAML keys are the field names; unset fields are left out when writing.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any, get_args, get_origin, get_type_hints

import yaml

KINDS = ("dimension", "time_dimension", "fact", "measure", "metric")
AGGREGATIONS = ("sum", "avg", "median", "min", "max", "count", "count_distinct")
JOIN_TYPES = ("inner", "left_outer", "right_outer", "full_outer", "cross")
CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many", "many_to_many")


def required(sql: bool = False, name: bool = False) -> Any:
    return field(default="", metadata={"required": True, "sql": sql, "name": name})


@dataclass
class BaseTable:
    database: str = ""
    schema: str = ""
    table: str = required()

    def __str__(self) -> str:
        return ".".join(p for p in (self.database, self.schema, self.table) if p)

    @staticmethod
    def parse(text: str) -> BaseTable:
        """Exactly three parts."""
        from ..functions.names import split_identifier

        parts = split_identifier(text)
        if len(parts) != 3:
            raise ValueError(f"{text!r} doesn't have the form database.schema.table")
        return BaseTable(*parts)


@dataclass
class Column:
    name: str = required(name=True)
    expr: str = required(sql=True)
    data_type: str = ""
    kind: str = ""
    description: str = ""
    synonyms: list[str] = field(default_factory=list)
    unique: bool = False
    default_aggregation: str = ""
    sample_values: list[str] = field(default_factory=list)
    is_enum: bool = False
    index_and_retrieve_values: bool = False
    search_service: dict = field(default_factory=dict)
    access_modifier: str = ""


@dataclass
class Metric:
    name: str = required(name=True)
    expr: str = required(sql=True)
    description: str = ""
    synonyms: list[str] = field(default_factory=list)
    filter: str = field(default="", metadata={"sql": True})
    access_modifier: str = ""


@dataclass
class NamedFilter:
    name: str = required(name=True)
    expr: str = required(sql=True)
    description: str = ""
    synonyms: list[str] = field(default_factory=list)


@dataclass
class PrimaryKey:
    columns: list[str] = field(default_factory=list)


@dataclass
class ForeignKey:
    columns: list[str] = field(default_factory=list)
    target: str = ""
    target_columns: list[str] = field(default_factory=list)


@dataclass
class Table:
    name: str = required(name=True)
    base_table: BaseTable = field(default_factory=BaseTable, metadata={"required": True})
    description: str = ""
    synonyms: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)
    dimensions: list[Column] = field(default_factory=list)
    time_dimensions: list[Column] = field(default_factory=list)
    measures: list[Column] = field(default_factory=list)
    facts: list[Column] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    filters: list[NamedFilter] = field(default_factory=list)
    primary_key: PrimaryKey | None = None
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def fields(self) -> list[Column]:
        return [*self.columns, *self.dimensions, *self.time_dimensions, *self.measures, *self.facts]

    def field(self, name: str) -> Column | None:
        return next((c for c in self.fields() if c.name.lower() == name.lower()), None)


@dataclass
class RelationKey:
    left_column: str = required()
    right_column: str = required()


@dataclass
class Relationship:
    name: str = required(name=True)
    left_table: str = required()
    right_table: str = required()
    relationship_columns: list[RelationKey] = field(default_factory=list)
    join_type: str = "inner"
    relationship_type: str = "many_to_one"
    via: str = ""


@dataclass
class VerifiedQuery:
    name: str = required()
    question: str = required()
    sql: str = required(sql=True)
    verified_at: int = 0
    verified_by: str = ""
    use_as_onboarding_question: bool = False


@dataclass
class SemanticModel:
    name: str = required(name=True)
    description: str = ""
    comments: str = ""
    tables: list[Table] = field(default_factory=list)
    relationships: list[Relationship] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    verified_queries: list[VerifiedQuery] = field(default_factory=list)
    custom_instructions: str = ""
    module_custom_instructions: dict = field(default_factory=dict)

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise KeyError(f"no logical table {name!r}")

    # ---- editing
    def put_table(self, table: Table) -> None:
        self.tables = [t for t in self.tables if t.name.lower() != table.name.lower()] + [table]

    def drop_table(self, name: str) -> None:
        low = name.lower()
        self.tables = [t for t in self.tables if t.name.lower() != low]
        self.relationships = [r for r in self.relationships if low not in (r.left_table.lower(), r.right_table.lower(), r.via.lower())]

    def put_column(self, table: str, section: str, column: Column) -> None:
        cols = getattr(self.table(table), section)
        cols[:] = [c for c in cols if c.name.lower() != column.name.lower()] + [column]

    def drop_column(self, table: str, name: str) -> None:
        t = self.table(table)
        for section in ("columns", "dimensions", "time_dimensions", "measures", "facts"):
            cols = getattr(t, section)
            cols[:] = [c for c in cols if c.name.lower() != name.lower()]

    def put_relationship(self, r: Relationship) -> None:
        if r.join_type not in JOIN_TYPES or r.relationship_type not in CARDINALITIES:
            raise ValueError(f"unknown join or relationship type in {r.name}")
        self.table(r.left_table), self.table(r.right_table)
        self.relationships = [x for x in self.relationships if x.name.lower() != r.name.lower()] + [r]

    def put_verified_query(self, q: VerifiedQuery) -> None:
        self.verified_queries = [x for x in self.verified_queries if x.name != q.name] + [q]


class ModelError(ValueError):
    pass


def to_dict(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        out = {}
        for f in dataclasses.fields(x):
            v = to_dict(getattr(x, f.name))
            if v not in ("", [], {}, None, False, 0) or f.metadata.get("required"):
                out[f.name] = v
        return out
    if isinstance(x, list):
        return [to_dict(v) for v in x]
    return x


def to_yaml(model: SemanticModel) -> str:
    return yaml.safe_dump(to_dict(model), sort_keys=False, allow_unicode=True, width=10_000)


def _build(kind: Any, value: Any, where: str) -> Any:
    origin = get_origin(kind)
    if origin is list:
        if not isinstance(value, list):
            raise ModelError(f"{where}: a list is expected")
        return [_build(get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is not None and type(None) in get_args(kind):
        return None if value is None else _build(next(a for a in get_args(kind) if a is not type(None)), value, where)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ModelError(f"{where}: a mapping is expected")
        hints, known = get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
        unknown = [k for k in value if k not in known]
        if unknown:
            raise ModelError(f"{where}: unknown keys {unknown}")
        for n, f in known.items():
            if f.metadata.get("required") and value.get(n) in (None, ""):
                raise ModelError(f"{where}: {n} is missing")
        return kind(**{k: _build(hints[k], v, f"{where}.{k}") for k, v in value.items() if v is not None})
    if kind is str:
        if isinstance(value, dict | list):
            raise ModelError(f"{where}: text is expected")
        return ("true" if value else "false") if isinstance(value, bool) else str(value)
    if kind is bool:
        if not isinstance(value, bool):
            raise ModelError(f"{where}: true or false is expected")
        return value
    if kind is int:
        return int(value)
    return value


def from_dict(data: dict) -> SemanticModel:
    return _build(SemanticModel, data, "model")


def from_yaml(text: str) -> SemanticModel:
    """Unknown keys, missing required ones and wrong shapes are errors; scalars are read as text where text is expected."""
    try:
        data = yaml.load(text, Loader=yaml.BaseLoader)
    except yaml.YAMLError as e:
        raise ModelError(f"not YAML: {e}") from e
    return from_dict(_typed(data))


def _typed(x: Any, key: str = "") -> Any:
    """Booleans and numbers of the fields that have them; everything else stays text."""
    if isinstance(x, dict):
        return {k: _typed(v, k) for k, v in x.items()}
    if isinstance(x, list):
        return [_typed(v) for v in x]
    if key in ("unique", "is_enum", "index_and_retrieve_values", "use_as_onboarding_question"):
        return {"true": True, "false": False}.get(str(x).lower(), x)
    return x


PLACEHOLDER = "  # <fill in>"


def mark_placeholders(text: str, token: str = "__") -> str:
    """Lines that end in the token get a note to fill them in."""
    return "\n".join(line[: -len(token)].rstrip() + " ''" + PLACEHOLDER if line.rstrip().endswith(f" {token}") else line for line in text.split("\n"))


def column_format(table: Table) -> Table:
    """All sections as one list of columns with kinds; nothing changes if the table has columns; both forms are an error."""
    sections = (("dimension", table.dimensions), ("time_dimension", table.time_dimensions), ("measure", table.measures), ("fact", table.facts))
    if not any(cols for _, cols in sections):
        return table
    if table.columns:
        raise ModelError(f"{table.name}: either columns or sections")
    columns = [dataclasses.replace(c, kind=kind) for kind, cols in sections for c in cols]
    return dataclasses.replace(table, columns=columns, dimensions=[], time_dimensions=[], measures=[], facts=[])
