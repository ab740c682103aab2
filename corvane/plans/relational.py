"""Tables as searchable resource types: parameters are columns, so filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.units import CURRENCY_SYSTEM
from corvane.operators.catalogue import Kind, Param, ResourceType, resource_type
from corvane.operators.criteria import Cells
from corvane.session import table


def _token(table_name: str, name: str, column: str) -> Param:
    return Param(name, Kind.TOKEN, column, system=f"urn:col:{table_name}.{column}")


def _ref(name: str, column: str, target: str) -> Param:
    return Param(name, Kind.REFERENCE, column, target=target)


def _money(name: str, column: str) -> Param:
    return Param(name, Kind.QUANTITY, column, system=CURRENCY_SYSTEM, code="USD")


#: The key of a line item: its four numbers, and a hash of the rest for rows that share them.
LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "hex(xxhash64(l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)))"
)
TYPES: dict[str, ResourceType] = {
    t.name: t
    for t in (
        resource_type("Region", "region", "r_regionkey", Param("name", Kind.STRING, "r_name")),
        resource_type("Nation", "nation", "n_nationkey", Param("name", Kind.STRING, "n_name"), _ref("region", "n_regionkey", "Region")),
        resource_type(
            "Customer", "customer", "c_custkey", Param("name", Kind.STRING, "c_name"), _token("customer", "segment", "c_mktsegment"),
            _ref("nation", "c_nationkey", "Nation"), Param("balance", Kind.NUMBER, "c_acctbal"),
        ),
        resource_type("Supplier", "supplier", "s_suppkey", Param("name", Kind.STRING, "s_name"), _ref("nation", "s_nationkey", "Nation"), Param("balance", Kind.NUMBER, "s_acctbal")),
        resource_type(
            "Part", "part", "p_partkey", Param("name", Kind.STRING, "p_name"), _token("part", "brand", "p_brand"),
            _token("part", "type", "p_type"), Param("size", Kind.NUMBER, "p_size"), _money("price", "p_retailprice"),
        ),
        resource_type(
            "Order", "orders", "o_orderkey", _token("orders", "status", "o_orderstatus"), _token("orders", "priority", "o_orderpriority"),
            _ref("customer", "o_custkey", "Customer"), _money("total", "o_totalprice"), Param("date", Kind.DATE, "o_orderdate"),
        ),
        resource_type(
            "LineItem", "lineitem", LINE_ID, _token("lineitem", "returnflag", "l_returnflag"), _token("lineitem", "linestatus", "l_linestatus"),
            _ref("order", "l_orderkey", "Order"), _ref("part", "l_partkey", "Part"), _ref("supplier", "l_suppkey", "Supplier"),
            Param("quantity", Kind.NUMBER, "l_quantity"), Param("discount", Kind.NUMBER, "l_discount"), Param("shipdate", Kind.DATE, "l_shipdate"),
        ),
        resource_type(
            "Event", "events", "event_id", _token("events", "type", "event_type"), _ref("subject", "user_id", "Customer"),
            Param("value", Kind.NUMBER, "value"), Param("k", Kind.NUMBER, "__k"), Param("ts", Kind.DATETIME, "ts"),
        ),
        resource_type("Document", "documents", "doc_id", Param("text", Kind.STRING, "text"), _token("documents", "lang", "lang"), _token("documents", "source", "source"), Param("n_chars", Kind.NUMBER, "n_chars")),
        resource_type("Label", "labels", "doc_id", _token("labels", "quality", "quality"), _token("labels", "toxic", "toxic"), _ref("document", "doc_id", "Document")),
        resource_type("Page", "pages", "page_id", Param("url", Kind.URI, "url")),
        resource_type("Turn", "conversations", "concat_ws('-', conv_id, turn)", Param("text", Kind.STRING, "text"), _token("conversations", "role", "role"), Param("turn", Kind.NUMBER, "turn")),
    )
}


class TableIndex:
    """Search index over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, types: dict[str, ResourceType] | None = None):
        self.spark, self.sf_dir, self.types = spark, sf_dir, types or TYPES

    def _type(self, name: str) -> ResourceType:
        if name not in self.types:
            raise ValueError(f"unknown resource type {name!r}")
        return self.types[name]

    def resources(self, type_: str) -> DataFrame:
        t = self._type(type_)
        rows = table(self.spark, self.sf_dir, t.table)
        if "k" in t.params and t.params["k"].source == "__k":
            rows = rows.withColumn("__k", F.get_json_object("props", "$.k").cast("double"))
        return rows.withColumn("__id", F.expr(t.id_sql))

    def param(self, type_: str, name: str) -> Param:
        return self._type(type_).param(name)

    def cells(self, type_: str, param: Param) -> Cells:
        col = F.col(param.source)
        if param.kind in (Kind.DATE, Kind.DATETIME):
            day = F.unix_date(F.to_date(col)).cast("long")
            at = day if param.kind is Kind.DATE else F.unix_millis(col.cast("timestamp"))
            return Cells(low=at, high=at, point=col)
        if param.kind in (Kind.TOKEN, Kind.REFERENCE):
            value = col.cast("string") if param.kind is Kind.TOKEN else F.concat(F.lit(f"{param.target}/"), col.cast("string"))
            raw = {"raw": col, "target": param.target} if param.kind is Kind.REFERENCE else {}
            return Cells(value=value, system=F.lit(param.system), **raw)
        if param.kind in (Kind.NUMBER, Kind.QUANTITY):
            return Cells(value=col.cast("double"), system=F.lit(param.system), code=F.lit(param.code))
        return Cells(value=col)

    def rows(self, type_: str, param: Param) -> tuple[DataFrame, Cells]:
        return self.resources(type_), self.cells(type_, param)

    def reference(self, type_: str, param: Param, target: str) -> DataFrame:
        if param.kind is not Kind.REFERENCE:
            raise ValueError(f"{type_}.{param.name} is no reference")
        edges = self.resources(type_).where(F.col(param.source).isNotNull())
        if param.target != target:
            edges = edges.where(F.lit(False))
        return edges.select("__id", F.col(param.source).alias("__ref"))

    def index_rows(self, type_: str, kind: Kind) -> DataFrame:
        """All index rows of a type and kind, as ``(resource_type, resource_id, name, value...)``."""
        parts = []
        for p in self._type(type_).params.values():
            if p.kind is kind:
                c = self.cells(type_, p)
                value = c.low if kind in (Kind.DATE, Kind.DATETIME) else c.value
                extra = [F.lit(p.system).alias("system")] if kind is Kind.TOKEN else [F.lit(p.system).alias("system"), F.lit(p.code).alias("code")] if kind is Kind.QUANTITY else []
                row = [F.lit(type_).alias("resource_type"), F.col("__id").cast("string").alias("resource_id"), F.lit(p.name).alias("name"), *extra, value.alias("value")]
                parts.append(self.resources(type_).where(value.isNotNull()).select(*row))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
