"""The log of local changes: append, squash, fetch, discard.

A log has ``seq, resource_type, resource_id, resource_uuid, ts, type, payload,
version_id``; ``type`` is INSERT, UPDATE or DELETE, the payload a document, a
list of patch operations, or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import json_diff, json_references, json_squash

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"
LOG = "seq long, resource_type string, resource_id string, resource_uuid string, ts timestamp, type string, payload string, version_id string"
KEY = ["resource_type", "resource_id", "resource_uuid"]


def _numbered(rows: DataFrame, after: int) -> DataFrame:
    """Rows with ``seq`` from ``after`` on; unique and ascending with the input's order, not without gaps."""
    return rows.withColumn("seq", F.monotonically_increasing_id() + after + 1).select(*(c.split()[0] for c in LOG.split(", ")))


def insert_changes(resources: DataFrame, ts: Column, after: int = 0) -> DataFrame:
    rows = resources.select(*KEY, ts.alias("ts"), F.lit(INSERT).alias("type"), F.col("json").alias("payload"), F.lit(None).cast("string").alias("version_id"))
    return _numbered(rows, after)


def update_changes(old: DataFrame, new: DataFrame, ts: Column, after: int = 0) -> DataFrame:
    """A change for each resource of ``new`` that differs from its stored document; equal ones leave no row."""
    before = old.select("resource_type", "resource_id", "resource_uuid", F.col("json").alias("old_json"), F.col("version_id"))
    both = new.select("resource_type", "resource_id", "json").join(before, ["resource_type", "resource_id"])
    rows = both.select(*KEY, ts.alias("ts"), F.lit(UPDATE).alias("type"), json_diff("old_json", "json").alias("payload"), "version_id")
    return _numbered(rows.where("payload <> '[]'"), after)


def delete_changes(stored: DataFrame, ts: Column, after: int = 0) -> DataFrame:
    return _numbered(stored.select(*KEY, ts.alias("ts"), F.lit(DELETE).alias("type"), F.lit("").alias("payload"), "version_id"), after)


def change_references(log: DataFrame) -> DataFrame:
    """``(seq, path, value)``: references that each change holds."""
    return log.where(F.col("type") != DELETE).select("seq", F.explode(json_references("payload")).alias("r")).select("seq", "r.path", "r.value")


def reference_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(resource_id, value)``: references that an update adds or takes away."""
    refs = lambda df: df.select("resource_id", F.explode(json_references("json")).alias("r")).select("resource_id", F.col("r.value").alias("value")).distinct()
    a, b = refs(old), refs(new)
    return a.join(b, ["resource_id", "value"], "left_anti").unionByName(b.join(a, ["resource_id", "value"], "left_anti"))


def lives(log: DataFrame) -> DataFrame:
    """The log with ``life``: how many deletions of the resource came before, so that a reused id starts anew.

    Only deletions are gathered by resource; the changes meet them in a join, which can split a hot resource.
    """
    at = F.struct("ts", "seq")
    ends = log.where(F.col("type") == DELETE).groupBy(*KEY).agg(F.collect_list(at).alias("__ends"))
    before = F.filter(F.coalesce("__ends", F.array().cast(ends.schema["__ends"].dataType)), lambda e: e < at)
    return log.join(ends, KEY, "left").withColumn("life", F.size(before).cast("long")).drop("__ends")


def squash_plan(log: DataFrame, *extra: Column) -> DataFrame:
    """For each resource and life: what its changes amount to, before any payload is touched.

    ``type`` is null where an insertion and a deletion cancel out. The version
    is the first change's, the time the last one's. Counted by partial
    aggregation, so a resource with very many changes is no hot spot.
    """
    first, last = F.min(F.struct("ts", "seq", "type", "version_id")), F.max(F.struct("ts", "seq", "type"))
    out = lives(log).groupBy(*KEY, "life").agg(
        first.alias("f"), last.alias("l"), F.count("*").alias("n_changes"),
        F.sum(((F.col("type") == INSERT)).cast("long")).alias("n_inserts"), *extra,
    )
    kind = (
        F.when((F.col("f.type") == INSERT) & (F.col("l.type") == DELETE), F.lit(None))
        .when(F.col("f.type") == INSERT, INSERT)
        .when(F.col("l.type") == DELETE, DELETE)
        .otherwise(UPDATE)
    )
    return out.select(*KEY, "life", kind.alias("type"), F.col("f.version_id").alias("version_id"), F.col("l.ts").alias("ts"), "n_changes", "n_inserts", *[c for c in out.columns if c not in {*KEY, "life", "f", "l", "n_changes", "n_inserts"}])


def squash(log: DataFrame) -> DataFrame:
    """One patch for each resource: inserts with their updates applied, updates merged in order, deletions alone.

    Columns: key, type, payload, version_id, ts, ``token`` (the sequence
    numbers it stands for) and ``valid`` (an insertion comes first). Changes
    that cancel out come as rows with a null type, so that they can be discarded.
    """
    steps = F.sort_array(F.collect_list(F.struct("ts", "seq", "type", "payload"))).alias("steps")
    plan = squash_plan(log, steps)
    base = F.when(F.col("type") == INSERT, F.element_at("steps", 1)["payload"])  # Python functions see every row
    patches = F.transform(F.filter("steps", lambda s: s["type"] == UPDATE), lambda s: s["payload"])
    wanted = F.when(F.col("type").isin(INSERT, UPDATE), patches).otherwise(F.array().cast("array<string>"))
    merged = plan.withColumn("squashed", json_squash(F.coalesce(F.col("type") == INSERT, F.lit(False)), base, wanted))
    payload = F.when(F.col("type").isin(INSERT, UPDATE), F.col("squashed")).when(F.col("type") == DELETE, F.lit(""))
    late = F.exists(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: s["type"] == INSERT)
    return merged.select(*KEY, "type", payload.alias("payload"), "version_id", "ts", F.transform("steps", lambda s: s["seq"]).alias("token"), (~late).alias("valid"))


def per_change(log: DataFrame) -> DataFrame:
    """Each change as a patch of its own."""
    return log.select(*KEY, "type", "payload", "version_id", "ts", F.array("seq").alias("token"), F.lit(True).alias("valid"))


def earliest_resource(log: DataFrame) -> DataFrame:
    """All changes of the resource whose change is the oldest, in order."""
    top = log.agg(F.min_by("resource_uuid", F.struct("ts", "seq")).alias("resource_uuid"))
    return log.join(F.broadcast(top), "resource_uuid", "left_semi").orderBy("ts", "seq")  # one row is sent out


def earliest_change(log: DataFrame) -> DataFrame:
    return log.orderBy("ts", "seq").limit(1)


def discard(log: DataFrame, tokens: DataFrame) -> DataFrame:
    """The log without the changes named in ``tokens(token array)``."""
    return log.join(tokens.select(F.explode("token").alias("seq")).distinct(), "seq", "left_anti")


def discard_resources(log: DataFrame, resources: DataFrame) -> DataFrame:
    return log.join(resources.select("resource_type", "resource_id"), ["resource_type", "resource_id"], "left_anti")


def change_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("resource_type", "resource_id").agg(F.count("*").alias("n_changes"))
