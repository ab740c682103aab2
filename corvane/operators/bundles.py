"""Upload requests: packing of patch groups, bundle entries, single requests, responses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import etag_version, location_parts


@dataclass(frozen=True)
class UploadStrategy:
    """How changes are fetched, turned into patches and sent."""

    squash: bool = True
    bundle: bool = True
    create_verb: str = "PUT"
    update_verb: str = "PATCH"
    bundle_size: int = 500
    etag: bool = True

    def __post_init__(self) -> None:
        if self.create_verb not in ("PUT", "POST") or self.update_verb not in ("PATCH", "PUT"):
            raise ValueError("create is PUT or POST, update is PATCH or PUT")
        if self.update_verb == "PUT" and not self.squash:
            raise ValueError("PUT for updates needs whole documents, so squashed changes")
        if self.bundle and not self.squash:
            raise ValueError("bundles need squashed changes")
        if self.bundle_size < 1:
            raise ValueError("a bundle holds a change at least")


def pack_groups(groups: DataFrame, bundle_size: int = 500) -> DataFrame:
    """``(position, size, bundle)`` of ``groups(position, size)``: greedy in order, a group is never split.

    A group above the limit gets a bundle of its own. The order makes this one
    sequential fold; it sees two numbers a group and keeps two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held = 0, 0
        for batch in batches:
            out = []
            for size in batch.column(1).to_pylist():
                if held and held + size > bundle_size:
                    bundle, held = bundle + 1, 0
                held += size
                out.append(bundle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["position", "size", "bundle"])

    rows = groups.select(F.col("position").cast("long").alias("position"), F.col("size").cast("long").alias("size"))
    return rows.repartition(1).sortWithinPartitions("position").mapInArrow(run, "position long, size long, bundle long")


def _verb(strategy: UploadStrategy) -> Column:
    return F.when(F.col("type") == "INSERT", strategy.create_verb).when(F.col("type") == "UPDATE", strategy.update_verb).otherwise("DELETE")


def bundle_entries(patches: DataFrame, strategy: UploadStrategy = UploadStrategy()) -> DataFrame:
    """Entry columns for each patch: verb, url, condition on the version, body (patches in Base64)."""
    url = F.concat_ws("/", "resource_type", "resource_id")
    match = F.when(F.lit(strategy.etag) & (F.col("type") != "INSERT") & F.col("version_id").isNotNull(), F.concat(F.lit('W/"'), F.col("version_id"), F.lit('"')))
    patched = (F.col("type") == "UPDATE") & F.lit(strategy.update_verb == "PATCH")
    body = F.when(F.col("type") == "DELETE", None).when(patched, F.base64(F.encode("payload", "utf-8"))).otherwise(F.col("payload"))
    return patches.withColumns(
        {
            "verb": _verb(strategy),
            "url": F.when((F.col("type") == "INSERT") & F.lit(strategy.create_verb == "POST"), F.col("resource_type")).otherwise(url),
            "if_match": match,
            "body": body,
            "content_type": F.when(patched, "application/json-patch+json").otherwise(F.when(F.col("type") != "DELETE", "application/json")),
        }
    )


def single_requests(patches: DataFrame, strategy: UploadStrategy = UploadStrategy(bundle=False)) -> DataFrame:
    """A request for each patch; patches are sent as they are, deletions without a body."""
    out = bundle_entries(patches, strategy)
    return out.withColumn("body", F.when(F.col("type") != "DELETE", F.col("payload")))


def map_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses by position; ``error`` where one is missing or is an outcome with issues."""
    both = requests.join(responses.withColumn("answered", F.lit(True)), ["bundle", "position"], "full")
    error = (
        F.when(F.col("answered").isNull(), "no response")
        .when(F.col("resource_type").isNull(), "no request")
        .when(F.coalesce(F.col("n_issues"), F.lit(0)) > 0, "outcome with issues")
    )
    return both.withColumns({"error": error, "new_version": etag_version(F.col("etag")), "new_place": location_parts(F.col("location"))})
