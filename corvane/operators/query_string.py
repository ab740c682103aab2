"""URL-style queries: ``Type?param=value&_sort=-name&_count=10``."""

from __future__ import annotations

from urllib.parse import unquote_plus

from corvane.functions.literals import parse_quantity, parse_token
from corvane.operators.catalogue import Kind
from corvane.operators.criteria import Date, Number, Quantity, Reference, Text, Token, Uri
from corvane.operators.search import Index, Search


def criterion(kind: Kind, text: str):
    """The criterion that a value stands for, by the parameter's kind."""
    if kind is Kind.TOKEN:
        system, code = parse_token(text)
        return Token(code, system)
    if kind is Kind.QUANTITY:
        value, system, unit = parse_quantity(text)
        return Quantity(value, system=system, unit=unit)
    made = {Kind.STRING: Text, Kind.REFERENCE: Reference, Kind.URI: Uri, Kind.NUMBER: Number, Kind.DATE: Date, Kind.DATETIME: Date}
    if kind not in made:
        raise ValueError(f"{kind.value} parameters cannot be searched")
    return made[kind](text)


def parse_query(index: Index, query: str) -> Search:
    """A search from a query string.

    Values are percent-decoded and commas in a value mean "or"; a repeated
    parameter is one more group, all of which must match. ``_sort`` takes
    several keys, ``-`` before a key means descending. Unknown parameters and
    malformed numbers raise ``ValueError``.
    """
    type_, _, rest = query.partition("?")
    out = Search(type_.strip())
    for part in filter(None, rest.split("&")):
        name, equals, value = part.partition("=")
        if not equals:
            raise ValueError(f"no value in {part!r}")
        name, values = unquote_plus(name), [unquote_plus(v) for v in value.split(",")]
        if name == "_count":
            out.count = int(values[0])
        elif name == "_offset":
            out.start = int(values[0])
        elif name == "_sort":
            for v in values:
                param = index.param(out.type, v.lstrip("-"))
                out.sort(param.name, v.startswith("-"))
        else:
            kind = index.param(out.type, name).kind
            out.filter(name, *(criterion(kind, v) for v in values))
    return out
