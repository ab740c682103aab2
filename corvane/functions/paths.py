"""Document paths of search parameters: members, unions, ``where``, ``as``, ``extension``, parentheses.

Values are flattened at each step. What is outside this subset makes the path
unsupported, and its parameter is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import Any

Step = Callable[[list], list]
_CALL = re.compile(r"(\w+)\((.*)\)")
_EQUAL = re.compile(r"\s*([\w.]+)\s*=\s*'([^']*)'\s*")
_NAME = re.compile(r"\w+")
#: Names of the members that hold a choice of types: ``value as Quantity`` is ``valueQuantity``.
_UPPER = lambda t: t[0].upper() + t[1:]


class Unsupported(ValueError):
    pass


def _flat(values: list) -> list:
    out = []
    for v in values:
        out += _flat(v) if isinstance(v, list) else [] if v is None else [v]
    return out


def _split(path: str, mark: str) -> list[str]:
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(path):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == mark and not depth and not quoted:
            out.append(path[last:i])
            last = i + 1
    return [*out, path[last:]]


def _member(name: str) -> Step:
    length = len(name)

    def step(values: list) -> list:
        out = []
        for v in values:
            if isinstance(v, dict):
                if name in v:
                    found = (v[name],)
                else:  # a choice of types: value -> valueQuantity, valueString ...
                    found = [x for k, x in v.items() if k.startswith(name) and k[length : length + 1].isupper()]
                for x in found:
                    if isinstance(x, list):
                        out += _flat(x)
                    elif x is not None:
                        out.append(x)
        return out

    return step


def _typed(name: str, kind: str) -> Step:
    full = name + _UPPER(kind)
    return lambda values: _flat([v[full] for v in values if isinstance(v, dict) and full in v])


def _chain(type_: str | None, names: list[str]) -> Callable[[Any], list]:
    """Members below one another: down a document as long as each is an object, and by ``_member`` from the first list or choice on."""
    steps = [_member(n) for n in names]
    places = [(n, steps[k], steps[k + 1 :]) for k, n in enumerate(names)]

    def run(doc: Any) -> list:
        if not isinstance(doc, dict):
            values = [v for v in _flat([doc]) if type_ is None or not isinstance(v, dict) or v.get("resourceType", type_) == type_]
            for s in steps:
                values = s(values)
            return values
        if type_ is not None and doc.get("resourceType", type_) != type_:
            return []
        for name, step, rest in places:
            v = doc.get(name)
            if isinstance(v, dict):
                doc = v
                continue
            values = _flat(v) if isinstance(v, list) else [v] if v is not None else [] if name in doc else step([doc])
            for s in rest:
                values = s(values)
            return values
        return [doc]

    return run


def _where(test: str) -> Step:
    m = _EQUAL.fullmatch(test)
    if not m:
        raise Unsupported(test)
    inner = evaluator(m[1])
    return lambda values: [v for v in values if m[2] in inner(v)]


@lru_cache(maxsize=4096)
def evaluator(path: str) -> Callable[[Any], list]:
    """The values of a path in a document (or of ``Type.path``, from the document itself)."""
    path = path.strip()
    parts = _split(path, "|")
    if len(parts) > 1:
        several = [evaluator(p) for p in parts]
        return lambda doc: [x for e in several for x in e(doc)]
    while path.startswith("(") and _split(path[1:], ")")[0] and path.endswith(")") and _balanced(path[1:-1]):
        return evaluator(path[1:-1])
    cast = re.fullmatch(r"\(?(.+?)\s+as\s+(\w+)\)?", path)
    if cast and "(" not in cast[1].lstrip("("):
        head, _, last = cast[1].rpartition(".")
        before, chosen = (evaluator(head) if head else lambda doc: [doc]), _typed(last, cast[2])
        return lambda doc: chosen(before(doc))
    steps: list[Step] = []
    names = _split(path, ".")
    if all(_NAME.fullmatch(n.strip()) for n in names):
        plain = [n.strip() for n in names]
        typed = plain[0][0].isupper()
        return _chain(plain[0] if typed and plain[0] != "Resource" else None, plain[typed:])
    for k, name in enumerate(names):
        name = name.strip()
        if name.startswith("(") and name.endswith(")"):
            inner = evaluator(name[1:-1])
            steps.append(lambda values, inner=inner: [x for v in values for x in inner(v)])
            continue
        call = _CALL.fullmatch(name)
        if call and call[1] == "where":
            steps.append(_where(call[2]))
        elif call and call[1] in ("as", "ofType"):
            if not steps:
                raise Unsupported(path)
            steps.pop()
            steps.append(_typed(names[k - 1].strip(), call[2].strip()))
        elif call and call[1] == "extension":
            steps.append(_member("extension"))
            steps.append(_where(f"url={call[2].strip()}"))
        elif call:
            raise Unsupported(path)
        elif _NAME.fullmatch(name):
            if k == 0 and name[0].isupper():
                steps.append(lambda values, name=name: [v for v in values if name == "Resource" or not isinstance(v, dict) or v.get("resourceType", name) == name])
            else:
                steps.append(_member(name))
        else:
            raise Unsupported(path)

    def run(doc: Any) -> list:
        values = _flat([doc])
        for s in steps:
            values = s(values)
        return values

    return run


def _balanced(text: str) -> bool:
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0
