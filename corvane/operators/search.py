"""Search requests and their compilation into one lazy DataFrame.

A request names a resource type, groups of criteria, reverse chains (``has``),
includes, a sort order and a page. Parameters that are columns of the type's own
table become predicates on its scan; parameters that live in index rows become
left-semi joins. Nothing is collected while a plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Literal, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.catalogue import Kind, Param
from corvane.operators.criteria import Cells, Criterion, predicate
from corvane.session import cut_lineage

Operation = Literal["and", "or"]
KEY = "__id"


@dataclass
class Group:
    """Criteria on one parameter; none at all asks for presence. Criteria apply to single index rows."""

    param: str
    criteria: tuple[Criterion, ...]
    operation: Operation = "or"


@dataclass
class Sort:
    param: str
    descending: bool = False


@dataclass
class Nested:
    """A search of another type that is tied to this one by a reference parameter."""

    param: str
    search: Search


@dataclass
class Search:
    type: str
    count: int | None = None
    start: int | None = None
    operation: Operation = "and"
    groups: list[Group] = field(default_factory=list)
    sorts: list[Sort] = field(default_factory=list)
    having: list[Nested] = field(default_factory=list)
    including: list[Nested] = field(default_factory=list)
    rev_including: list[Nested] = field(default_factory=list)

    def filter(self, param: str, *criteria: Criterion, operation: Operation = "or") -> Search:
        self.groups.append(Group(param, criteria, operation))
        return self

    def sort(self, param: str, descending: bool = False) -> Search:
        self.sorts.append(Sort(param, descending))
        return self

    def _nest(self, to: list[Nested], type_: str, param: str, build) -> Search:
        inner = Search(type_)
        if build:
            build(inner)
        to.append(Nested(param, inner))
        return self

    def has(self, type_: str, param: str, build=None) -> Search:
        """Keep resources that a matching resource of ``type_`` refers to by ``param``."""
        return self._nest(self.having, type_, param, build)

    def include(self, type_: str, param: str, build=None) -> Search:
        """Also return resources of ``type_`` that the results refer to by ``param``."""
        return self._nest(self.including, type_, param, build)

    def rev_include(self, type_: str, param: str, build=None) -> Search:
        """Also return resources of ``type_`` that refer to the results by ``param``."""
        return self._nest(self.rev_including, type_, param, build)

    def page(self, count: int | None, start: int | None = None) -> Search:
        self.count, self.start = count, start
        return self


def params_of(request: Search) -> list[tuple[str, str]]:
    """Type and name of each parameter that a request looks at, once for each use."""
    out = [(request.type, g.param) for g in request.groups] + [(request.type, s.param) for s in request.sorts]
    out += [(request.type, n.param) for n in request.including] + [(n.search.type, n.param) for n in (*request.having, *request.rev_including)]
    return out + [u for n in (*request.having, *request.including, *request.rev_including) for u in params_of(n.search)]


class Index(Protocol):
    """Where resources and their parameters are."""

    def resources(self, type_: str) -> DataFrame:
        """Rows of a type with their key in ``__id``."""

    def param(self, type_: str, name: str) -> Param: ...

    def cells(self, type_: str, param: Param) -> Cells | None:
        """Cells on the resource row itself, where each resource has exactly one value; else ``None``."""

    def rows(self, type_: str, param: Param) -> tuple[DataFrame, Cells]:
        """Index rows with ``__id`` and the cells on them."""

    def reference(self, type_: str, param: Param, target: str) -> DataFrame:
        """``(__id, __ref)``: keys of ``target`` resources referred to."""


def _combine(columns: list[Column], operation: Operation) -> Column:
    return reduce(lambda a, b: a & b if operation == "and" else a | b, columns)


def _present(kind: Kind, cells: Cells) -> Column:
    value = cells.point if cells.point is not None else cells.low if kind in (Kind.DATE, Kind.DATETIME) else cells.value
    return value.isNotNull()


def _variants(index: Index, type_: str, param: Param) -> list[Param]:
    return index.variants(type_, param) if hasattr(index, "variants") else [param]


def group_predicate(index: Index, type_: str, group: Group, cells: Cells, kind: Kind | None = None) -> Column:
    kind = kind or index.param(type_, group.param).kind
    tests = [predicate(kind, cells, c) for c in group.criteria]
    present = _present(kind, cells)
    return present & _combine(tests, group.operation) if tests else present


def group_keys(index: Index, type_: str, group: Group) -> DataFrame:
    """Keys of the resources with an index row that satisfies the group, of any kind that the parameter has."""
    parts = []
    for param in _variants(index, type_, index.param(type_, group.param)):
        rows, cells = index.rows(type_, param)
        parts.append(rows.where(group_predicate(index, type_, group, cells, param.kind)).select(KEY))
    return reduce(DataFrame.unionByName, parts)


def matching(index: Index, search: Search) -> DataFrame:
    """Resources that satisfy filters and reverse chains; neither sorted nor cut to a page.

    Filter groups are combined by ``search.operation`` and the whole is then
    joined by AND with the reverse chains, which are combined among
    themselves by the same operation.
    """
    out = index.resources(search.type)
    direct, keyed = [], []
    for g in search.groups:
        cells = index.cells(search.type, index.param(search.type, g.param))
        direct.append(group_predicate(index, search.type, g, cells)) if cells is not None else keyed.append(g)
    if search.operation == "and":
        if direct:
            out = out.where(_combine(direct, "and"))
        for g in keyed:
            out = out.join(group_keys(index, search.type, g), KEY, "left_semi")
    elif direct and not keyed:
        out = out.where(_combine(direct, "or"))
    elif keyed:
        sets = [group_keys(index, search.type, g) for g in keyed]
        if direct:
            sets.append(index.resources(search.type).where(_combine(direct, "or")).select(KEY))
        out = out.join(reduce(DataFrame.unionByName, sets).distinct(), KEY, "left_semi")
    chains = [chain_keys(index, search.type, n) for n in search.having]
    if chains and search.operation == "or":
        chains = [reduce(DataFrame.unionByName, chains)]
    for keys in chains:
        out = out.join(keys, KEY, "left_semi")
    return out


def chain_keys(index: Index, parent: str, nested: Nested) -> DataFrame:
    """Keys of ``parent`` resources that the nested search's matches refer to; a left-semi join needs no distinct."""
    inner = nested.search
    edges = index.reference(inner.type, index.param(inner.type, nested.param), parent)
    if inner.groups or inner.having:
        edges = edges.join(matching(index, inner).select(KEY), KEY, "left_semi")
    return edges.select(F.col("__ref").alias(KEY))


def sort_columns(index: Index, type_: str, rows: DataFrame, sorts: list[Sort]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with sort keys, and the order: least value ascending, greatest descending, nulls last, ties by key."""
    order: list[Column] = []
    for k, s in enumerate(sorts):
        param = index.param(type_, s.param)
        if param.kind not in (Kind.STRING, Kind.NUMBER, Kind.DATE, Kind.DATETIME):
            raise NotImplementedError(f"no sort order on a {param.kind.value} parameter")
        cells = index.cells(type_, param)
        names = [f"__sort{k}"]
        if cells is not None:
            rows = rows.withColumn(names[0], cells.point if cells.point is not None else cells.value)
        else:
            variants = _variants(index, type_, param)
            names = [f"__sort{k}_{v}" for v in range(len(variants))]
            for own, name in zip(variants, names, strict=True):
                found, cells = index.rows(type_, own)
                value = cells.low if own.kind in (Kind.DATE, Kind.DATETIME) else cells.value
                pick = F.max if s.descending else F.min
                rows = rows.join(found.groupBy(KEY).agg(pick(value).alias(name)), KEY, "left")
        order += [F.desc_nulls_last(n) if s.descending else F.asc_nulls_last(n) for n in names]
    return rows, [*order, F.asc(KEY)]


def search(index: Index, request: Search) -> DataFrame:
    """The page of matching resources, in order; ``__rank`` counts from 1 where an order or a page was asked for."""
    rows = matching(index, request)
    if not request.sorts and request.count is None and not request.start:
        return rows
    own = rows.columns
    rows, order = sort_columns(index, request.type, rows, request.sorts)
    rows = rows.orderBy(*order)
    if request.start:
        rows = rows.offset(request.start)
    if request.count is not None:
        rows = rows.limit(request.count)
    return rows.select(*own)


def count(index: Index, request: Search) -> DataFrame:
    """One row ``n``: how many resources match; the page and the order do not matter."""
    return matching(index, request).agg(F.count("*").alias("n"))


def included(index: Index, request: Search, base: DataFrame | None = None) -> DataFrame:
    """``(base_id, direction, type, param, resource_id)`` of included and reverse-included resources, long form.

    Filters, chains, order and page of a nested search hold for it; with a
    page, ``rank`` limits the resources of each base row. ``base(base_id)``: the
    request's results, if they are known.
    """
    if base is None:
        base = search(index, request).select(F.col(KEY).alias("base_id"))
        base = cut_lineage(base) if len(request.including) + len(request.rev_including) > 1 else base
    parts: list[DataFrame] = []
    for nested in request.including:
        inner = nested.search
        edges = index.reference(request.type, index.param(request.type, nested.param), inner.type)
        edges = edges.join(base.withColumnRenamed("base_id", KEY), KEY, "left_semi").select(F.col(KEY).alias("base_id"), F.col("__ref").alias(KEY))
        parts.append(_stitched(index, inner, edges, "include", nested.param))
    for nested in request.rev_including:
        inner = nested.search
        edges = index.reference(inner.type, index.param(inner.type, nested.param), request.type)
        edges = edges.withColumnRenamed("__ref", "base_id").join(base, "base_id", "left_semi")
        parts.append(_stitched(index, inner, edges, "rev_include", nested.param))
    if not parts:
        raise ValueError("nothing is included")
    return reduce(DataFrame.unionByName, parts)


def _stitched(index: Index, inner: Search, edges: DataFrame, direction: str, param: str) -> DataFrame:
    from pyspark.sql import Window

    found = matching(index, inner)
    found, order = sort_columns(index, inner.type, found, inner.sorts)
    keys = [c for c in found.columns if c.startswith("__sort")]
    rows = edges.distinct().join(found.select(KEY, *keys), KEY)
    # With a page, the filter on the bare row number lets each task keep its first rows of a base before they are shuffled.
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy(*order)) if inner.sorts or inner.count is not None else F.lit(None).cast("int")
    rows = rows.withColumn("rank", rank)
    if inner.count is not None:
        rows = rows.where((F.col("rank") > (inner.start or 0)) & (F.col("rank") <= (inner.start or 0) + inner.count))
    return rows.select(
        "base_id", F.lit(direction).alias("direction"), F.lit(inner.type).alias("type"), F.lit(param).alias("param"), F.col(KEY).alias("resource_id"), F.col("rank").cast("long").alias("rank")
    )


def stitched(index: Index, request: Search) -> DataFrame:
    """``(base_id, included map, rev_included map)``: a row for each result of the page.

    Keys are parameters for includes and ``type.param`` for reverse includes;
    values are the ids, in the nested order.
    """
    base = cut_lineage(search(index, request).select(F.col(KEY).alias("base_id")))  # ids alone, found once
    key = F.when(F.col("direction") == "include", F.col("param")).otherwise(F.concat_ws(".", "type", "param"))
    lists = (
        included(index, request, base)
        .groupBy("base_id", "direction", key.alias("k"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "resource_id"))), lambda x: x["resource_id"]).alias("ids"))
    )
    maps = lists.groupBy("base_id").agg(
        *(
            F.map_from_entries(F.filter(F.collect_list(F.when(F.col("direction") == d, F.struct("k", "ids"))), lambda x: x.isNotNull())).alias(name)
            for d, name in (("include", "included"), ("rev_include", "rev_included"))
        )
    )
    return base.join(maps, "base_id", "left")
