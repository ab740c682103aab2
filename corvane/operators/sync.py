"""Synchronisation as joins: conflicts, resolution, new ids, high-water marks, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import json_references, json_replace, json_with_id

PAIR = ["resource_type", "resource_id"]


def conflicts(downloaded: DataFrame, log: DataFrame) -> DataFrame:
    """Downloaded resources that have local changes, by type and id."""
    return downloaded.join(log.select(*PAIR), PAIR, "left_semi")


def accept_local(local: Column, remote: Column) -> Column:
    return local


def accept_remote(local: Column, remote: Column) -> Column:
    return remote


def resolve(local: DataFrame, remote: DataFrame, log: DataFrame, policy: Callable[[Column, Column], Column] = accept_remote, value: str = "json") -> DataFrame:
    """``remote`` with the policy's choice where a resource has local changes; ``conflict`` marks those rows."""
    marked = log.select(*PAIR).distinct().withColumn("conflict", F.lit(True))
    mine = local.select(*PAIR, F.col(value).alias("__local"))
    both = remote.join(marked, PAIR, "left").join(mine, PAIR, "left")
    hit = F.coalesce("conflict", F.lit(False)) & F.col("__local").isNotNull()
    return both.withColumns({value: F.when(hit, policy(F.col("__local"), F.col(value))).otherwise(F.col(value)), "conflict": hit}).drop("__local")


def high_water(resources: DataFrame, updated: str = "last_updated") -> DataFrame:
    """``(resource_type, high_water)``: from where the next download of a type goes on."""
    return resources.groupBy("resource_type").agg(F.max(updated).alias("high_water"))


def newer_than(resources: DataFrame, marks: DataFrame, updated: str = "last_updated") -> DataFrame:
    """Resources above their type's mark, and all of types without one."""
    both = resources.join(marks, "resource_type", "left")
    return both.where(F.col("high_water").isNull() | (F.col(updated) > F.col("high_water"))).drop("high_water")


def download_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum(F.coalesce("total", F.lit(0))), F.lit(0)).cast("long").alias("total"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(done / total)


def _replaced(rows: DataFrame, ids: DataFrame, key: list[str], text: str) -> tuple[DataFrame, Column]:
    """``rows`` joined with the changes of their references, and the text with these put in.

    References are taken out as rows, joined with the ids and put back by
    ``key``, so neither side has to fit anywhere.
    """
    named = ids.select(F.concat_ws("/", "resource_type", "old_id").alias("value"), F.concat_ws("/", "resource_type", "new_id").alias("new_value"))
    refs = rows.select(*key, F.explode(F.array_distinct(F.transform(json_references(text), lambda r: r["value"]))).alias("value"))
    changes = refs.join(named, "value").groupBy(*key).agg(F.collect_list(F.struct("value", "new_value")).alias("__c"))
    put = json_replace(text, F.transform("__c", lambda x: x["value"]), F.transform("__c", lambda x: x["new_value"]))
    own = ids.select("resource_type", F.col("old_id").alias("resource_id"), F.col("new_id").alias("__new"))
    return rows.join(changes, key, "left").join(own, PAIR, "left"), put


def rewrite_ids(resources: DataFrame, ids: DataFrame) -> DataFrame:
    """``resources`` with new ids in place of old ones, in keys, documents and references; ``rewritten`` marks referrers.

    ``ids`` has ``(resource_type, old_id, new_id)``.
    """
    out, text = _replaced(resources, ids, PAIR, "json")
    none = F.lit(None).cast("string")
    text = F.when(F.col("__new").isNotNull(), json_with_id(text, F.col("__new"), none, none)).otherwise(text)
    return out.withColumns({"json": text, "resource_id": F.coalesce("__new", "resource_id"), "rewritten": F.col("__c").isNotNull()}).drop("__c", "__new")


def rewrite_log(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The change log with new ids: in documents of insertions and in values of updates; deletions hold none."""
    out, text = _replaced(log, ids, ["seq"], "payload")
    none = F.lit(None).cast("string")
    whole = (F.col("type") == "INSERT") & F.col("__new").isNotNull()
    text = F.when(F.col("type") == "DELETE", F.col("payload")).when(whole, json_with_id(F.when(whole, text), F.col("__new"), none, none)).otherwise(text)
    return out.withColumns({"payload": text, "resource_id": F.coalesce("__new", "resource_id")}).drop("__c", "__new")


def with_server_meta(resources: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored resources with the version and time that a server gave them; without an answer they stay as they are."""
    new = answers.select(*PAIR, F.col("version_id").alias("__v"), F.col("last_updated").alias("__u"))
    out = resources.join(new, PAIR, "left")
    return out.withColumns({"version_id": F.coalesce("__v", "version_id"), "last_updated_remote": F.coalesce("__u", "last_updated_remote")}).drop("__v", "__u")
