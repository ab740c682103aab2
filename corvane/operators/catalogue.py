"""Search-parameter definitions and how resource types map onto tables or documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(Enum):
    NUMBER = "number"
    DATE = "date"
    DATETIME = "datetime"
    STRING = "string"
    TOKEN = "token"
    REFERENCE = "reference"
    QUANTITY = "quantity"
    URI = "uri"
    POSITION = "position"
    COMPOSITE = "composite"


@dataclass(frozen=True)
class Param:
    """A search parameter: name, kind, and where its values are.

    ``source`` is a column of a table, or a path of a document. ``system`` and
    ``code`` are constants that a table's values carry; ``target`` is the type
    that a reference column points to.
    """

    name: str
    kind: Kind
    source: str
    system: str | None = None
    code: str | None = None
    target: str | None = None

    def value(self) -> Column:
        return F.col(self.source)


@dataclass(frozen=True)
class ResourceType:
    """A type that lives in a table: its table, the expression of its id, and its parameters by name."""

    name: str
    table: str
    id_sql: str
    params: dict[str, Param] = field(default_factory=dict)

    def param(self, name: str) -> Param:
        if name == "_id":
            return Param("_id", Kind.TOKEN, "__id")
        if name not in self.params:
            raise ValueError(f"{self.name} has no search parameter {name!r}")
        return self.params[name]

    def with_params(self, *extra: Param) -> ResourceType:
        """The type with custom parameters after its own ones."""
        return ResourceType(self.name, self.table, self.id_sql, {**self.params, **{p.name: p for p in extra}})


def resource_type(name: str, table: str, id_sql: str, *params: Param) -> ResourceType:
    return ResourceType(name, table, id_sql, {p.name: p for p in params})
