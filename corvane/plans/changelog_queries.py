"""Change-log, ordering, upload, synchronisation and streaming operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import json_diff
from corvane.operators import bundles, changes, ordering, sync
from corvane.session import table
from corvane.streaming.ingest import read_table_stream, run_upsert

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

KIND = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"
LOG_SQL = f"SELECT event_id AS seq, 'Customer' AS resource_type, CAST(user_id AS VARCHAR) AS resource_id, ts, {KIND} AS type, props AS payload, CAST(event_id % 9 AS VARCHAR) AS version_id FROM events"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of customers: signups insert, errors delete, the rest updates."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.lit("Customer").alias("resource_type"), F.col("user_id").cast("string").alias("resource_id"),
        F.col("user_id").cast("string").alias("resource_uuid"), "ts", F.expr(KIND).alias("type"), F.col("props").alias("payload"), (F.col("event_id") % 9).cast("string").alias("version_id"),
    )


@_query(
    "change_squash_type",
    f"""
WITH l AS ({LOG_SQL}), v AS (
  SELECT *, coalesce(sum(CAST(type = 'DELETE' AS INT)) OVER (PARTITION BY resource_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM l
), n AS (
  SELECT *, row_number() OVER (PARTITION BY resource_id, life ORDER BY ts, seq) AS a, row_number() OVER (PARTITION BY resource_id, life ORDER BY ts DESC, seq DESC) AS z FROM v
)
SELECT resource_id, CAST(life AS BIGINT) AS life, CASE WHEN max(type) FILTER (a = 1) = 'INSERT' THEN CASE WHEN max(type) FILTER (z = 1) = 'DELETE' THEN NULL ELSE 'INSERT' END
  WHEN max(type) FILTER (z = 1) = 'DELETE' THEN 'DELETE' ELSE 'UPDATE' END AS type,
  max(version_id) FILTER (a = 1) AS version_id, max(ts) AS ts, count(*) AS n_changes FROM n GROUP BY resource_id, life""",
)
def _(spark, d):
    return changes.squash_plan(event_log(spark, d)).select("resource_id", "life", "type", "version_id", "ts", "n_changes")


@_query("change_counts", "SELECT 'Customer' AS resource_type, CAST(user_id AS VARCHAR) AS resource_id, count(*) AS n_changes FROM events GROUP BY user_id")
def _(spark, d):
    return changes.change_counts(event_log(spark, d))


@_query("change_total", "SELECT count(*) AS n FROM events")
def _(spark, d):
    return event_log(spark, d).agg(F.count("*").alias("n"))


@_query("change_earliest_resource", "SELECT event_id AS seq, ts FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts, event_id LIMIT 1)")
def _(spark, d):
    return changes.earliest_resource(event_log(spark, d)).select("seq", "ts")


@_query("change_earliest", "SELECT event_id AS seq, ts FROM events ORDER BY ts, event_id LIMIT 1")
def _(spark, d):
    return changes.earliest_change(event_log(spark, d)).select("seq", "ts")


@_query("change_discard_resources", "SELECT event_id AS seq FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("Customer").alias("resource_type"), F.col("c_custkey").cast("string").alias("resource_id"))
    return changes.discard_resources(event_log(spark, d), gone).select("seq")


@_query("change_discard_tokens", "SELECT event_id AS seq FROM events WHERE event_type <> 'error'")
def _(spark, d):
    log = event_log(spark, d)
    return changes.discard(log, changes.per_change(log).where("type = 'DELETE'")).select("seq")


@_query(
    "json_diff_props",
    """
WITH p AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = json_extract_string(before, '$.k') THEN '[]'
  ELSE '[{"op":"replace","path":"/k","value":' || json_extract_string(props, '$.k') || '}]' END AS patch FROM p WHERE before IS NOT NULL""",
)
def _(spark, d):
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("before", before).where("before IS NOT NULL")
    return rows.select("event_id", json_diff("before", "props").alias("patch"))


# Conflicts: suppliers as local edits of customers with the same key.
def _pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.lit("Customer").alias("resource_type"), F.col(key).cast("string").alias("resource_id"), F.col(value).alias("json"))


@_query("conflict_ids", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def _(spark, d):
    found = sync.conflicts(_pairs(table(spark, d, "customer"), "c_custkey", "c_name"), event_log(spark, d))
    return found.select(F.col("resource_id").cast("long").alias("id"))


def _resolved(policy):
    def run(spark: SparkSession, d: str) -> DataFrame:
        remote, local = _pairs(table(spark, d, "customer"), "c_custkey", "c_name"), _pairs(table(spark, d, "supplier"), "s_suppkey", "s_name")
        return sync.resolve(local, remote, event_log(spark, d), policy).select(F.col("resource_id").cast("long").alias("id"), "json", "conflict")

    return run


for _name, _policy, _take in (("remote", sync.accept_remote, "c_name"), ("local", sync.accept_local, "CASE WHEN hit THEN s_name ELSE c_name END")):
    _query(
        f"conflict_accept_{_name}",
        f"SELECT c_custkey AS id, {_take} AS json, hit AS conflict FROM (SELECT *, s_name IS NOT NULL AND c_custkey IN (SELECT user_id FROM events) AS hit FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)",
    )(_resolved(_policy))


@_query(
    "reference_rewrite",
    "SELECT o_orderkey AS id, 'Customer/' || CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey + 1000000 ELSE o_custkey END AS subject, coalesce(c_mktsegment = 'BUILDING', false) AS rewritten FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    ids = ids.select(F.lit("Customer").alias("resource_type"), F.col("c_custkey").cast("string").alias("old_id"), (F.col("c_custkey") + 1000000).cast("string").alias("new_id"))
    made = F.to_json(F.struct(F.struct(F.concat(F.lit("Customer/"), "o_custkey").alias("reference")).alias("subject")))
    docs = table(spark, d, "orders").select(F.lit("Order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), made.alias("json"))
    out = sync.rewrite_ids(docs, ids)
    return out.select(F.col("resource_id").cast("long").alias("id"), F.get_json_object("json", "$.subject.reference").alias("subject"), "rewritten")


@_query("high_water_by_type", "SELECT event_type AS resource_type, max(ts) AS high_water FROM events GROUP BY event_type")
def _(spark, d):
    return sync.high_water(table(spark, d, "events").withColumnRenamed("event_type", "resource_type"), "ts")


@_query("download_newer", "SELECT event_id FROM events e WHERE event_type <> 'view' AND ts > (SELECT max(ts) FROM events x WHERE x.event_type = e.event_type AND x.ts < TIMESTAMP '2024-01-20') OR event_type = 'view'")
def _(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_type", "resource_type")
    marks = sync.high_water(rows.where("ts < timestamp_ntz '2024-01-20' AND resource_type <> 'view'"), "ts")
    return sync.newer_than(rows, marks, "ts").select("event_id")


@_query("download_summary", "SELECT event_type AS resource_type, count(*) AS total FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("resource_type")).agg(F.count("*").alias("total"))


@_query("download_total", "SELECT count(*) AS total FROM events")
def _(spark, d):
    return sync.download_total(QUERIES["download_summary"](spark, d))


@_query("progress_fraction", "SELECT event_type, CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*) AS progress FROM events GROUP BY event_type")
def _(spark, d):
    done = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("done"), F.count("*").alias("total"))
    return done.select("event_type", sync.progress(F.col("done"), F.col("total")).alias("progress"))


@_query("server_meta", "SELECT c_custkey AS id, coalesce(s_name, 'old') AS version_id FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(spark, d):
    stored = _pairs(table(spark, d, "customer"), "c_custkey", "c_name").withColumns({"version_id": F.lit("old"), "last_updated_remote": F.lit(None).cast("timestamp")})
    answers = _pairs(table(spark, d, "supplier"), "s_suppkey", "s_name").select("resource_type", "resource_id", F.col("json").alias("version_id"), F.lit(None).cast("timestamp").alias("last_updated"))
    return sync.with_server_meta(stored, answers).select(F.col("resource_id").cast("long").alias("id"), "version_id")


# Ordering and upload.
@_query("adjacency_insert_only", "SELECT 'Order/' || o_orderkey AS src, 'Customer/' || o_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment = 'BUILDING'")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.lit("Order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'DELETE' WHEN 'F' THEN 'UPDATE' ELSE 'INSERT' END").alias("type"), F.concat(F.lit("Customer/"), "o_custkey").alias("value"))
    people = table(spark, d, "customer").select(F.lit("Customer").alias("resource_type"), F.col("c_custkey").cast("string").alias("resource_id"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'INSERT' ELSE 'UPDATE' END").alias("type"))
    return ordering.insert_adjacency(orders.drop("value").unionByName(people), orders.select("resource_type", "resource_id", "value"))


@_query(
    "topo_level",
    "SELECT 'R' || r_regionkey AS node, CAST(0 AS BIGINT) AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'S' || s_suppkey, 2 FROM supplier",
)
def _(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    nodes = table(spark, d, "region").select(name("R", "r_regionkey").alias("node")).unionByName(n.select(name("N", "n_nationkey").alias("node"))).unionByName(s.select(name("S", "s_suppkey").alias("node")))
    edges = n.select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst")).unionByName(s.select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("dst")))
    return ordering.levels(nodes, edges)


@_query(
    "scc_components",
    """
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation), r AS (
  SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src
)
SELECT n_nationkey AS node, least(n_nationkey, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = n_nationkey), n_nationkey)) AS component FROM nation""",
)
def _(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return ordering.strongly_connected(nodes, nodes.select(F.col("node").alias("src"), ((F.col("node") * 3 + 1) % 25).alias("dst")))


@_query("bundle_packing", "SELECT c_custkey AS position, CAST(1 AS BIGINT) AS size, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS BIGINT) AS bundle FROM customer")
def _(spark, d):
    return bundles.pack_groups(table(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.lit(1).alias("size")))


@_query(
    "bundle_packing_groups",
    """
WITH RECURSIVE g AS (SELECT CAST(n_nationkey AS BIGINT) AS position, CAST(1 + n_nationkey * 5 % 13 AS BIGINT) AS size FROM nation), f AS (
  SELECT position, size, CAST(0 AS BIGINT) AS bundle, size AS held FROM g WHERE position = 0
  UNION ALL SELECT g.position, g.size, CASE WHEN held + g.size > 10 THEN bundle + 1 ELSE bundle END, CASE WHEN held + g.size > 10 THEN g.size ELSE held + g.size END
  FROM f JOIN g ON g.position = f.position + 1
)
SELECT position, size, bundle FROM f""",
)
def _(spark, d):
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), (1 + F.col("n_nationkey") * 5 % 13).alias("size"))
    return bundles.pack_groups(groups, 10)


@_query(
    "upload_entries",
    f"""SELECT seq, CASE type WHEN 'INSERT' THEN 'PUT' WHEN 'UPDATE' THEN 'PATCH' ELSE 'DELETE' END AS verb, 'Customer/' || resource_id AS url,
  CASE WHEN type <> 'INSERT' THEN 'W/"' || version_id || '"' END AS if_match,
  CASE type WHEN 'INSERT' THEN payload WHEN 'UPDATE' THEN base64(encode(payload)) END AS body FROM ({LOG_SQL})""",
)
def _(spark, d):
    patches = changes.per_change(event_log(spark, d))
    return bundles.bundle_entries(patches).select(F.element_at("token", 1).alias("seq"), "verb", "url", "if_match", "body")


@_query("upload_single_requests", f"SELECT seq, CASE type WHEN 'INSERT' THEN 'POST' WHEN 'UPDATE' THEN 'PATCH' ELSE 'DELETE' END AS verb, CASE type WHEN 'INSERT' THEN 'Customer' ELSE 'Customer/' || resource_id END AS url, CASE WHEN type <> 'DELETE' THEN payload END AS body FROM ({LOG_SQL})")
def _(spark, d):
    patches = changes.per_change(event_log(spark, d))
    return bundles.single_requests(patches, bundles.UploadStrategy(bundle=False, create_verb="POST")).select(F.element_at("token", 1).alias("seq"), "verb", "url", "body")


@_query(
    "stream_upsert_latest",
    "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def _(spark, d):
    stream = read_table_stream(spark, d, "events")
    return run_upsert(spark, stream, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type", "value")
