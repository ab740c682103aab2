"""Every search and change-log operator as a query over the driver's tables, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.units import CURRENCY_SYSTEM
from corvane.operators.catalogue import Kind
from corvane.operators.criteria import Date, Modifier, Number, Quantity, Reference, Text, Token, Uri
from corvane.operators.query_string import parse_query
from corvane.operators.search import Search, count, included, search, sort_columns, stitched
from corvane.plans.relational import TYPES, TableIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

COLUMNS = {
    "Region": ["r_regionkey", "r_name"], "Nation": ["n_nationkey", "n_name"], "Customer": ["c_custkey", "c_name"],
    "Supplier": ["s_suppkey", "s_name"], "Part": ["p_partkey", "p_name"], "Order": ["o_orderkey", "o_totalprice"],
    "LineItem": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "Event": ["event_id", "user_id"],
    "Document": ["doc_id", "source"], "Label": ["doc_id", "quality"], "Page": ["page_id", "url"], "Turn": ["conv_id", "turn", "role"],
}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _searching(name: str, request: Callable[[], Search], where: str) -> None:
    """A search whose rows are those of one table under ``where``."""
    t = request().type
    cols = COLUMNS[t]
    _query(name, f"SELECT {', '.join(cols)} FROM {TYPES[t].table} WHERE {where}")(
        lambda spark, d: search(TableIndex(spark, d), request()).select(*cols)
    )


# Strings, tokens, references, uris.
_searching("string_starts_with", lambda: Search("Part").filter("name", Text("RED")), "starts_with(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'red')")
_searching("string_exact", lambda: Search("Nation").filter("name", Text("NATION_3", Modifier.EXACT), Text("CANADA", Modifier.EXACT)), "n_name IN ('NATION_3', 'CANADA')")
_searching("string_contains", lambda: Search("Part").filter("name", Text("AN", Modifier.CONTAINS)), "contains(translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'an')")
_searching("string_literal_wildcard", lambda: Search("Customer").filter("name", Text("%_", Modifier.CONTAINS)), "contains(c_name, '%_')")
_searching("string_contains_documents", lambda: Search("Document").filter("text", Text("THE OF", Modifier.CONTAINS)), "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the of')")
_searching("token_code", lambda: Search("Customer").filter("segment", Token("BUILDING")), "c_mktsegment = 'BUILDING'")
_searching("token_system_code", lambda: Search("Order").filter("status", Token("F", "urn:col:orders.o_orderstatus")), "o_orderstatus = 'F'")
_searching("token_other_system", lambda: Search("Order").filter("status", Token("F", "urn:other")), "false")
_searching("token_multi_or", lambda: Search("LineItem").filter("returnflag", Token("A"), Token("R")), "l_returnflag IN ('A', 'R')")
_searching("token_multi_and_one_row", lambda: Search("LineItem").filter("returnflag", Token("A"), Token("R"), operation="and"), "l_returnflag = 'A' AND l_returnflag = 'R'")
_searching("token_numeric_code", lambda: Search("Label").filter("quality", Token("1")), "quality = 1")
_searching("token_id", lambda: Search("Order").filter("_id", Token("7"), Token("32")), "o_orderkey IN (7, 32)")
_searching("reference_eq", lambda: Search("Order").filter("customer", Reference("Customer/42")), "o_custkey = 42")
_searching("reference_many_or", lambda: Search("Order").filter("customer", *(Reference(f"Customer/{k}") for k in range(1, 9))), "o_custkey BETWEEN 1 AND 8")
_searching("reference_other_type", lambda: Search("Order").filter("customer", Reference("Supplier/42")), "false")
_searching("uri_eq", lambda: Search("Page").filter("url", Uri("https://thther.example.org/en/685")), "url = 'https://thther.example.org/en/685'")

# Numbers and quantities.
for _p, _w in {
    "eq": "p_size >= 9.5 AND p_size < 10.5", "ne": "p_size < 9.5 OR p_size >= 10.5", "gt": "p_size > 10", "ge": "p_size >= 10",
    "lt": "p_size < 10", "le": "p_size <= 10", "ap": "p_size >= 9 AND p_size <= 11",
}.items():
    _searching(f"number_{_p}", lambda p=_p: Search("Part").filter("size", Number("10", p)), _w)
_searching("number_sa", lambda: Search("LineItem").filter("discount", Number("0.05", "sa")), "l_discount > 0.05")
_searching("number_eb", lambda: Search("LineItem").filter("discount", Number("0.05", "eb")), "l_discount < 0.05")
_searching("number_eq_decimal", lambda: Search("LineItem").filter("discount", Number("0.05")), "l_discount >= 0.045 AND l_discount < 0.055")
_searching("number_eq_tens", lambda: Search("LineItem").filter("quantity", Number("1E+1")), "l_quantity >= 5 AND l_quantity < 15")
_searching("number_ap_negative", lambda: Search("Customer").filter("balance", Number("-500", "ap")), "c_acctbal >= -550 AND c_acctbal <= -450")
_searching("number_from_json", lambda: Search("Event").filter("k", Number("3", "ge")), "CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 3")
_searching("quantity_system_code", lambda: Search("Part").filter("price", Quantity("950", "ge", CURRENCY_SYSTEM, "USD")), "p_retailprice >= 950")
_searching("quantity_eq", lambda: Search("Order").filter("total", Quantity("100000", "ap", CURRENCY_SYSTEM, "USD")), "o_totalprice >= 90000 AND o_totalprice <= 110000")
_searching("quantity_ne_unit", lambda: Search("Part").filter("price", Quantity("1000", "ne", unit="USD")), "p_retailprice < 999.5 OR p_retailprice >= 1000.5")
_searching("quantity_other_unit", lambda: Search("Part").filter("price", Quantity("1", "gt", unit="EUR")), "false")
_searching("quantity_no_unit", lambda: Search("Part").filter("price", Quantity("1200.5", "lt")), "p_retailprice < 1200.5")

# Dates at each precision with each prefix.
for _n, _lit, _a, _b in (
    ("year", "1997", "TIMESTAMP '1997-01-01'", "TIMESTAMP '1998-01-01'"),
    ("month", "1997-03", "TIMESTAMP '1997-03-01'", "TIMESTAMP '1997-04-01'"),
    ("day", "1997-03-14", "TIMESTAMP '1997-03-14'", "TIMESTAMP '1997-03-15'"),
):
    for _p, _w in {
        "eq": "o_orderdate >= {a} AND o_orderdate < {b}", "ne": "o_orderdate < {a} OR o_orderdate >= {b}", "gt": "o_orderdate >= {b}", "ge": "o_orderdate >= {a}",
        "lt": "o_orderdate < {a}", "le": "o_orderdate < {b}", "sa": "o_orderdate >= {b}", "eb": "o_orderdate < {a}",
    }.items():
        _searching(f"date_{_p}_{_n}", lambda p=_p, lit=_lit: Search("Order").filter("date", Date(lit, p)), _w.format(a=_a, b=_b))
for _n, _lit, _a, _b in (
    ("day", "2024-01-10", "TIMESTAMP '2024-01-10'", "TIMESTAMP '2024-01-11'"),
    ("second", "2024-01-01T00:03:52Z", "TIMESTAMP '2024-01-01 00:03:52'", "TIMESTAMP '2024-01-01 00:03:53'"),
    ("offset", "2024-01-10T12:30+02:00", "TIMESTAMP '2024-01-10 10:30:00'", "TIMESTAMP '2024-01-10 10:31:00'"),
):
    for _p, _w in {"eq": "ts >= {a} AND ts < {b}", "ne": "ts < {a} OR ts >= {b}", "gt": "ts >= {b}", "ge": "ts >= {a}", "lt": "ts < {a}", "le": "ts < {b}", "sa": "ts >= {b}", "eb": "ts < {a}"}.items():
        _searching(f"datetime_{_p}_{_n}", lambda p=_p, lit=_lit: Search("Event").filter("ts", Date(lit, p)), _w.format(a=_a, b=_b))
_searching("date_ap_fixed_now", lambda: Search("Order").filter("date", Date("1997-03-14", "ap", now="1998-03-14")), "o_orderdate >= TIMESTAMP '1997-02-05' AND o_orderdate < TIMESTAMP '1997-04-21'")
_searching("datetime_ap_fixed_now", lambda: Search("Event").filter("ts", Date("2024-01-10T00:00:00Z", "ap", now="2024-01-20T00:00:00Z")), "epoch_ms(ts) BETWEEN 1704844800000 - 86400000 AND 1704844800999 + 86399900")
_searching("date_or_values", lambda: Search("Order").filter("date", Date("1996"), Date("1998-02")), "year(o_orderdate) = 1996 OR (year(o_orderdate) = 1998 AND month(o_orderdate) = 2)")

# Groups.
_searching("groups_and", lambda: Search("Part").filter("brand", Token("Brand#1"), Token("Brand#12"), Token("Brand#2")).filter("size", Number("20", "lt")), "p_brand IN ('Brand#1', 'Brand#12', 'Brand#2') AND p_size < 20")
_searching("groups_or", lambda: Search("Order", operation="or").filter("status", Token("P")).filter("total", Quantity("300000", "gt")), "o_orderstatus = 'P' OR o_totalprice > 300000")
_searching("presence", lambda: Search("Event").filter("value"), "value IS NOT NULL")
_searching("default_type", lambda: Search("Nation"), "true")


# Reverse chains.
_RECENT = "SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_totalprice > 200000"
_searching(
    "has_one",
    lambda: Search("Customer").filter("segment", Token("BUILDING")).has("Order", "customer", lambda s: s.filter("date", Date("1997-01-01", "ge")).filter("total", Quantity("200000", "gt"))),
    f"c_mktsegment = 'BUILDING' AND c_custkey IN ({_RECENT})",
)
_searching("has_presence", lambda: Search("Customer").has("Event", "subject"), "c_custkey IN (SELECT user_id FROM events)")
_searching(
    "has_two_and",
    lambda: Search("Customer").has("Order", "customer", lambda s: s.filter("status", Token("F"))).has("Event", "subject", lambda s: s.filter("type", Token("error"))),
    "c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')",
)
_searching(
    "has_two_or",
    lambda: Search("Customer", operation="or").has("Order", "customer", lambda s: s.filter("total", Quantity("300000", "gt"))).has("Event", "subject", lambda s: s.filter("type", Token("error"))),
    "c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) OR c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')",
)
_searching(
    "has_chain_depth2",
    lambda: Search("Nation").has("Customer", "nation", lambda c: c.has("Order", "customer", lambda o: o.filter("total", Quantity("320000", "gt")))),
    "n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 320000))",
)
_searching("has_filters_or_bracketed", lambda: Search("Nation", operation="or").filter("name", Text("N")).filter("region", Reference("Region/1")).has("Supplier", "nation", lambda s: s.filter("balance", Number("0", "lt"))), "(starts_with(translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'n') OR n_regionkey = 1) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
_searching("has_wrong_target", lambda: Search("Supplier").has("Order", "customer"), "false")


# Includes.
def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("base_id").cast("string").alias("base_id"), "direction", "type", "param", F.col("resource_id").cast("string").alias("resource_id"))


def _inc(direction: str, type_: str, param: str, base: str, rid: str, rest: str) -> str:
    return f"SELECT CAST({base} AS VARCHAR) AS base_id, '{direction}' AS direction, '{type_}' AS type, '{param}' AS param, CAST({rid} AS VARCHAR) AS resource_id FROM {rest}"


@_query("include_forward", _inc("include", "Nation", "nation", "c_custkey", "n_nationkey", "customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"))
def _(spark, d):
    return _rows(included(TableIndex(spark, d), Search("Customer").filter("segment", Token("BUILDING")).include("Nation", "nation")))


@_query("include_filtered", _inc("include", "Customer", "customer", "o_orderkey", "c_custkey", "orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000 AND c_acctbal < 0"))
def _(spark, d):
    return _rows(included(TableIndex(spark, d), Search("Order").filter("total", Quantity("250000", "gt")).include("Customer", "customer", lambda s: s.filter("balance", Number("0", "lt")))))


@_query("include_with_chain", _inc("include", "Customer", "customer", "o_orderkey", "c_custkey", "orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')"))
def _(spark, d):
    return _rows(included(TableIndex(spark, d), Search("Order").filter("total", Quantity("200000", "gt")).include("Customer", "customer", lambda s: s.has("Event", "subject", lambda e: e.filter("type", Token("error"))))))


@_query("revinclude", _inc("rev_include", "Order", "customer", "c_custkey", "o_orderkey", "customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000"))
def _(spark, d):
    return _rows(included(TableIndex(spark, d), Search("Customer").filter("balance", Number("9000", "gt")).rev_include("Order", "customer")))


@_query(
    "revinclude_two_types",
    _inc("rev_include", "Order", "customer", "c_custkey", "o_orderkey", "customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'F'")
    + " UNION ALL " + _inc("rev_include", "Event", "subject", "c_custkey", "event_id", "customer JOIN events ON user_id = c_custkey WHERE c_acctbal > 5000 AND event_type IN ('error', 'signup')"),
)
def _(spark, d):
    s = Search("Customer").filter("balance", Number("5000", "gt"))
    s.rev_include("Order", "customer", lambda o: o.filter("status", Token("F"))).rev_include("Event", "subject", lambda e: e.filter("type", Token("error"), Token("signup")))
    return _rows(included(TableIndex(spark, d), s))


@_query("include_skipped_when_empty", _inc("include", "Nation", "nation", "c_custkey", "n_nationkey", "customer JOIN nation ON c_nationkey = n_nationkey WHERE false"))
def _(spark, d):
    return _rows(included(TableIndex(spark, d), Search("Customer").filter("segment", Token("none")).include("Nation", "nation")))


@_query(
    "revinclude_sorted_top3",
    "SELECT * FROM (SELECT c_custkey AS base_id, o_orderkey AS resource_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice_day DESC NULLS LAST, o_orderkey) AS rank "
    "FROM customer JOIN (SELECT *, o_orderdate AS o_totalprice_day FROM orders) ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY') WHERE rank <= 3",
)
def _(spark, d):
    s = Search("Customer").filter("segment", Token("MACHINERY")).rev_include("Order", "customer", lambda o: o.sort("date", descending=True).page(3))
    return included(TableIndex(spark, d), s).select("base_id", "resource_id", "rank")


@_query(
    "include_stitched",
    "SELECT c_custkey AS base_id, (SELECT count(*) FROM nation WHERE n_nationkey = c_nationkey) AS n_included, "
    "count(o_orderkey) AS n_rev_included, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 7000 GROUP BY c_custkey, c_nationkey",
)
def _(spark, d):
    out = stitched(TableIndex(spark, d), Search("Customer").filter("balance", Number("7000", "gt")).include("Nation", "nation").rev_include("Order", "customer"))
    orders = F.coalesce(F.try_element_at("rev_included", F.lit("Order.customer")), F.array().cast("array<bigint>"))
    return out.select(
        "base_id",
        F.coalesce(F.size(F.try_element_at("included", F.lit("nation"))), F.lit(0)).cast("long").alias("n_included"),
        F.size(orders).cast("long").alias("n_rev_included"),
        F.array_min(orders).alias("first_order"),
        F.array_max(orders).alias("last_order"),
    )


# Sorting and paging; the place in the order is a column, since rows are compared without order.
def _sorted(name: str, request: Callable[[], Search], order: str, where: str = "true") -> None:
    t = request().type
    cols, key = COLUMNS[t], TYPES[t].id_sql
    s = request()
    low, high = (s.start or 0), (s.start or 0) + (s.count if s.count is not None else 10**9)
    sql = f"SELECT * FROM (SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {order}, {key}) AS place FROM {TYPES[t].table} WHERE {where}) WHERE place > {low} AND place <= {high}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        index, r = TableIndex(spark, d), request()
        page = search(index, r)
        page, by = sort_columns(index, r.type, page, r.sorts)
        return page.select(*cols, (F.row_number().over(Window.orderBy(*by)) + low).cast("long").alias("place"))  # a page of bounded size

    _query(name, sql)(run)


_sorted("sort_string_asc", lambda: Search("Customer", count=50).sort("name"), "c_name ASC NULLS LAST")
_sorted("sort_string_desc", lambda: Search("Customer", count=50).sort("name", descending=True), "c_name DESC NULLS LAST")
_sorted("sort_number", lambda: Search("Part", count=40).filter("brand", Token("Brand#12")).sort("size"), "p_size ASC NULLS LAST", "p_brand = 'Brand#12'")
_sorted("sort_date_desc", lambda: Search("Order", count=100).sort("date", descending=True), "o_orderdate DESC NULLS LAST")
_sorted("sort_two_keys", lambda: Search("Customer", count=30).sort("balance", descending=True).sort("name"), "c_acctbal DESC NULLS LAST, c_name ASC NULLS LAST")
_sorted("sort_nulls_last", lambda: Search("Event", count=200, start=100).sort("k"), "CAST(json_extract_string(props, '$.k') AS DOUBLE) ASC NULLS LAST")
_sorted("page_limit_offset", lambda: Search("Order", count=25, start=50).filter("status", Token("O")).sort("date"), "o_orderdate ASC NULLS LAST", "o_orderstatus = 'O'")
_sorted("flagship", lambda: Search("Customer", count=10).filter("segment", Token("BUILDING")).has("Order", "customer", lambda s: s.filter("date", Date("1997-01-01", "ge")).filter("total", Quantity("200000", "gt"))).sort("name"), "c_name ASC NULLS LAST", f"c_mktsegment = 'BUILDING' AND c_custkey IN ({_RECENT})")


@_query(
    "sort_multivalue_minmax",
    "SELECT c_custkey AS customer, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def _(spark, d):
    """The least and greatest of several values of a resource: what an ascending and a descending sort look at."""
    index = TableIndex(spark, d)
    orders = index.reference("Order", index.param("Order", "customer"), "Customer").join(index.resources("Order").select("__id", "o_orderdate"), "__id")
    best = orders.groupBy("__ref").agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"))
    base = index.resources("Customer").select("__id")
    return base.join(best, base["__id"] == best["__ref"], "left").select(F.col("__id").alias("customer"), "earliest", "latest")


# Counts.
@_query("count_filtered", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, d):
    return count(TableIndex(spark, d), Search("Order", count=5, start=3).filter("status", Token("F")).filter("total", Quantity("100000", "gt")).sort("date"))


@_query("count_has", f"SELECT count(*) AS n FROM customer WHERE c_custkey IN ({_RECENT})")
def _(spark, d):
    return count(TableIndex(spark, d), Search("Customer").has("Order", "customer", lambda s: s.filter("date", Date("1997-01-01", "ge")).filter("total", Quantity("200000", "gt"))))


# Query strings.
def _string(name: str, query: str, where: str) -> None:
    t = query.partition("?")[0]
    cols = COLUMNS[t]

    def run(spark: SparkSession, d: str) -> DataFrame:
        index = TableIndex(spark, d)
        return search(index, parse_query(index, query)).select(*cols)

    _query(name, f"SELECT {', '.join(cols)} FROM {TYPES[t].table} WHERE {where}")(run)


_string("xquery_token", "Customer?segment=BUILDING", "c_mktsegment = 'BUILDING'")
_string("xquery_token_system", "Order?status=urn%3Acol%3Aorders.o_orderstatus|F", "o_orderstatus = 'F'")
_string("xquery_two_params", "Order?status=F&date=1997", "o_orderstatus = 'F' AND year(o_orderdate) = 1997")
_string("xquery_repeated_param", "Part?name=red&name=re", "starts_with(lower(p_name), 'red')")
_string("xquery_comma_or", "LineItem?returnflag=A,N&quantity=7", "l_returnflag IN ('A', 'N') AND l_quantity >= 6.5 AND l_quantity < 7.5")
_string("xquery_quantity", f"Part?price=950.5|{CURRENCY_SYSTEM}|USD", "p_retailprice >= 950.45 AND p_retailprice < 950.55")
_string("xquery_reference", "Order?customer=Customer/42", "o_custkey = 42")
_string("xquery_sorted_page", "Customer?_sort=-balance,name&_count=20&_offset=5", "c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_name, c_custkey LIMIT 20 OFFSET 5)")


# Index rows.
def _index(name: str, type_: str, kind: Kind, parts: list[str]) -> None:
    _query(name, " UNION ALL ".join(parts))(lambda spark, d: TableIndex(spark, d).index_rows(type_, kind))


_index("index_rows_string", "Part", Kind.STRING, ["SELECT 'Part' AS resource_type, CAST(p_partkey AS VARCHAR) AS resource_id, 'name' AS name, p_name AS value FROM part WHERE p_name IS NOT NULL"])
_index("index_rows_token", "Order", Kind.TOKEN, [f"SELECT 'Order' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id, '{n}' AS name, 'urn:col:orders.{c}' AS system, {c} AS value FROM orders WHERE {c} IS NOT NULL" for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])
_index("index_rows_reference", "Nation", Kind.REFERENCE, ["SELECT 'Nation' AS resource_type, CAST(n_nationkey AS VARCHAR) AS resource_id, 'region' AS name, 'Region/' || n_regionkey AS value FROM nation"])
_index("index_rows_number", "Event", Kind.NUMBER, [f"SELECT 'Event' AS resource_type, CAST(event_id AS VARCHAR) AS resource_id, '{n}' AS name, {c} AS value FROM events WHERE {c} IS NOT NULL" for n, c in (("value", "value"), ("k", "CAST(json_extract_string(props, '$.k') AS DOUBLE)"))])
_index("index_rows_quantity", "Part", Kind.QUANTITY, [f"SELECT 'Part' AS resource_type, CAST(p_partkey AS VARCHAR) AS resource_id, 'price' AS name, '{CURRENCY_SYSTEM}' AS system, 'USD' AS code, p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL"])
_index("index_rows_date", "Order", Kind.DATE, ["SELECT 'Order' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id, 'date' AS name, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS value FROM orders WHERE o_orderdate IS NOT NULL"])
_index("index_rows_datetime", "Event", Kind.DATETIME, ["SELECT 'Event' AS resource_type, CAST(event_id AS VARCHAR) AS resource_id, 'ts' AS name, epoch_us(ts) // 1000 AS value FROM events WHERE ts IS NOT NULL"])
_index("index_rows_uri", "Page", Kind.URI, ["SELECT 'Page' AS resource_type, CAST(page_id AS VARCHAR) AS resource_id, 'url' AS name, url AS value FROM pages WHERE url IS NOT NULL"])

from corvane.plans import changelog_queries  # noqa: E402  they come after the searches

QUERIES.update(changelog_queries.QUERIES)
ORACLE_SQL.update(changelog_queries.ORACLE_SQL)
