"""Downloads: requests by type and high-water mark, pages and their links, summaries, retries.

The transport is a callable from a request to a parsed response, so tests and
other transports plug in; responses land as rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import sanitise

PAGE = "request string, status string, error string, resource_type string, resource_id string, last_updated string, json string"


def query_url(type_: str, params: dict[str, str]) -> str:
    return type_ + ("?" + "&".join(f"{quote(k, safe='_')}={quote(v, safe=':,|')}" for k, v in params.items()) if params else "")


@dataclass
class DownloadPlan:
    """Requests for resource types; a type's pages are followed before the next type."""

    params: dict[str, dict[str, str]]
    marks: dict[str, str] = field(default_factory=dict)

    def first_request(self, type_: str) -> str:
        own = dict(self.params[type_])
        own.setdefault("_sort", "_lastUpdated")
        if type_ in self.marks and "_lastUpdated" not in own:
            own["_lastUpdated"] = f"gt{self.marks[type_]}"
        return query_url(type_, own)

    def summary_requests(self) -> list[str]:
        return [query_url(t, {**p, "_summary": "count"}) for t, p in self.params.items()]

    def accept(self, response: dict[str, Any]) -> tuple[list[dict], str | None]:
        """Resources of a response and the link to the next page; marks move to the newest of each type."""
        if response.get("resourceType") == "OperationOutcome":
            raise ValueError(json.dumps(response.get("issue", [])))
        if response.get("resourceType") != "Bundle" or response.get("type") != "searchset":
            return [], None
        found = [e["resource"] for e in response.get("entry", []) if "resource" in e]
        for r in found:
            at = r.get("meta", {}).get("lastUpdated")
            if at and at > self.marks.get(r["resourceType"], ""):
                self.marks[r["resourceType"]] = at
        after = next((x["url"] for x in response.get("link", []) if x.get("relation") == "next"), None)
        return found, after


def total(plan: DownloadPlan, get: Callable[[str], dict]) -> int:
    return sum(get(r).get("total") or 0 for r in plan.summary_requests())


def pages(plan: DownloadPlan, get: Callable[[str], dict]) -> Iterator[tuple[str, str | None, list[dict]]]:
    """``(request, error, resources)``; a failed request ends its type and not the download."""
    for type_ in plan.params:
        request: str | None = plan.first_request(type_)
        while request:
            try:
                found, after = plan.accept(get(request))
                yield request, None, found
            except Exception as e:  # noqa: BLE001  any failure of the transport is a failed page
                yield request, str(e), []
                after = None
            request = after


def download(spark: SparkSession, plan: DownloadPlan, get: Callable[[str], dict]) -> Iterator[DataFrame]:
    """A DataFrame for each page: its resources, or one row with the error."""
    for request, error, found in pages(plan, get):
        rows = [(request, "success", None, r["resourceType"], r.get("id"), r.get("meta", {}).get("lastUpdated"), sanitise(json.dumps(r))) for r in found]
        yield spark.createDataFrame(rows if error is None else [(request, "failure", error, None, None, None, None)], PAGE)


@dataclass(frozen=True)
class Retry:
    """How often and after how long a failed job is tried again."""

    times: int = 3
    base_seconds: float = 30.0
    exponential: bool = False

    def delay(self, attempt: int) -> float:
        return self.base_seconds * 2**attempt if self.exponential else self.base_seconds

    def run(self, job: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        for attempt in range(self.times + 1):
            try:
                return job()
            except Exception:
                if attempt == self.times:
                    raise
                sleep(self.delay(attempt))
        return None


def high_water_of(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'success'").groupBy("resource_type").agg(F.max("last_updated").alias("high_water"))
