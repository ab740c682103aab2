"""A versioned store of documents: resources, index rows and change log as Parquet snapshots.

Every write puts the tables that it changes into a new folder and then adds a
numbered pointer that names the folder of each table; the highest number is the
current snapshot. The pointer appears by one rename, older ones stay until
``vacuum``, and two writers cannot take the same number. So a reader sees one
whole snapshot, a write that fails at any step changes nothing, and tables that
a write does not change are neither read nor written. Index rows are partitioned
by type and kind.
"""

from __future__ import annotations

import json
import uuid as uuids
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.jsonpatch import json_references, json_with_id
from corvane.operators import changes as log_ops
from corvane.operators.catalogue import Param
from corvane.operators.documents import INDEX, DocumentIndex, index_documents, seed_catalogue
from corvane.operators.query_string import parse_query
from corvane.operators.search import Search, count, included, search, stitched
from corvane.operators.sync import PAIR, accept_remote, conflicts, resolve, rewrite_ids, rewrite_log, with_server_meta
from corvane.session import cut_lineage

RESOURCES = "uuid string, resource_type string, resource_id string, json string, version_id string, last_updated_remote timestamp, last_updated_local timestamp"
STATE = "key string, value string"


class NotFound(KeyError):
    pass


class PendingChanges(ValueError):
    pass


class Conflict(RuntimeError):
    pass


class Store:
    """Create, read, update, delete, search, and the log of local changes."""

    def __init__(self, spark: SparkSession, root: str, catalogue: dict[str, list[Param]] | None = None, clock=F.current_timestamp):
        self.spark, self.root, self.catalogue, self.clock = spark, root.rstrip("/"), catalogue or seed_catalogue(), clock
        self._pending: dict[str, DataFrame] | None = None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Snapshots.
    def _numbers(self) -> list[int]:
        """Numbers of all snapshots, ascending."""
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n.removeprefix("at-")) for n in names if n.startswith("at-"))

    def _snapshot(self, number: int | None = None) -> dict[str, str]:
        """The folder of each table in a snapshot, the current one by default; none before the first write."""
        numbers = [number] if number is not None else self._numbers()[-1:]
        return json.loads(self.spark.read.text(f"{self.root}/at-{numbers[0]:012d}").first()[0]) if numbers else {}

    def _table(self, name: str, schema: str) -> DataFrame:
        if self._pending is not None and name in self._pending:
            return self._pending[name]
        found = self._snapshot().get(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{found}/{name}") if found else self.spark.createDataFrame([], schema)

    @property
    def resources(self) -> DataFrame:
        return self._table("resources", RESOURCES)

    @property
    def index(self) -> DataFrame:
        return self._table("index", INDEX)

    @property
    def log(self) -> DataFrame:
        return self._table("log", log_ops.LOG)

    @property
    def state(self) -> DataFrame:
        return self._table("state", STATE)

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        if self._pending is not None:
            self._pending.update(tables)
            return
        name, before = f"v-{uuids.uuid4().hex}", self._numbers()
        for key, df in tables.items():
            writer = df.write
            if key == "resources":
                writer = writer.partitionBy("resource_type")
            if key == "index":
                writer = writer.partitionBy("resource_type", "kind")
            writer.parquet(f"{self.root}/{name}/{key}")
        pointer = json.dumps({**self._snapshot(), **dict.fromkeys(tables, name)})
        self._point(pointer, (before[-1] if before else 0) + 1, name)

    def _point(self, pointer: str, number: int, name: str) -> None:
        """Makes the snapshot current by one rename; fails if another writer came first."""
        fresh, place = self._path(f"{self.root}/new-{name}"), self._path(f"{self.root}/at-{number:012d}")
        self.spark.createDataFrame([(pointer,)], "value string").coalesce(1).write.text(fresh.toString())
        if self._fs.exists(place) or not self._fs.rename(fresh, place):
            self._fs.delete(fresh, True)
            raise Conflict(f"another writer has made snapshot {number}")

    def transaction(self, block: Callable[[Store], None]) -> None:
        """All writes of ``block`` become one snapshot, or none if it raises."""
        self._pending = {}
        try:
            block(self)
            tables = self._pending
        finally:
            self._pending = None
        self._commit(tables)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all snapshots but the current one and the ``keep - 1`` before it, and what only they, or no one, need."""
        numbers = self._numbers()
        kept = numbers[-max(1, keep) :]
        needed = {f for n in kept for f in self._snapshot(n).values()} | {f"at-{n:012d}" for n in kept}
        for s in self._fs.listStatus(self._path(self.root)):
            if s.getPath().getName().partition("-")[0] in ("v", "at", "new") and s.getPath().getName() not in needed:
                self._fs.delete(s.getPath(), True)

    # Writing.
    def _put(self, rows: DataFrame, log: DataFrame | None, extra: dict[str, DataFrame] | None = None) -> None:
        names = [c.split()[0] for c in RESOURCES.split(", ")]
        if "__n" in rows.columns:
            rows = rows.groupBy(*PAIR).agg(F.max_by(F.struct(*(c for c in names if c not in PAIR)), "__n").alias("last")).select(*PAIR, "last.*")
        rows = rows.select(*names)
        kept = self.resources.join(rows.select(*PAIR), PAIR, "left_anti")
        old = self.index.join(rows.select("uuid"), "uuid", "left_anti")
        fresh = index_documents(rows, self.catalogue)
        tables = {"resources": kept.unionByName(rows), "index": old.unionByName(fresh)}
        if log is not None:
            tables["log"] = self.log.unionByName(log)
        self._commit(tables | (extra or {}))

    def _after(self) -> int:
        return self.log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def _prepared(self, documents: DataFrame, local: bool) -> DataFrame:
        """``documents(json)`` as resource rows; ids are made where there are none, known resources keep their uuid."""
        own_id = F.coalesce(F.get_json_object("json", "$.id"), F.expr("uuid()") if local else F.raise_error(F.lit("a remote resource needs an id")))
        rows = documents.select("json", F.get_json_object("json", "$.resourceType").alias("resource_type"), own_id.cast("string").alias("resource_id"), F.monotonically_increasing_id().alias("__n"))
        rows = cut_lineage(rows)  # ids that are made once stay
        known = self.resources.select(*PAIR, "uuid")
        none = F.lit(None).cast("string")
        return rows.join(known, PAIR, "left").select(
            F.coalesce("uuid", F.sha2(F.concat_ws("/", *PAIR), 256)).alias("uuid"), *PAIR,
            json_with_id("json", F.col("resource_id"), none, none).alias("json"),
            F.get_json_object("json", "$.meta.versionId").alias("version_id"),
            F.get_json_object("json", "$.meta.lastUpdated").cast("timestamp").alias("last_updated_remote"),
            (self.clock() if local else F.lit(None)).cast("timestamp").alias("last_updated_local"), "__n",
        )

    def create(self, documents: DataFrame) -> DataFrame:
        """Stores new documents and logs the insertions; returns their ``(resource_type, resource_id)``.

        Of documents with one type and id the last is stored, in the order in
        which Spark reads them; all are logged.
        """
        rows = self._prepared(documents, True)
        self._put(rows, log_ops.insert_changes(rows.orderBy("__n").withColumnRenamed("uuid", "resource_uuid"), self.clock(), self._after()))
        return rows.select(*PAIR)

    def insert_remote(self, documents: DataFrame) -> None:
        """Stores a server's documents, without a trace in the log."""
        self._put(self._prepared(documents, False), None)

    def update(self, documents: DataFrame) -> None:
        """Replaces documents that must exist, all of them or none, and logs the differences."""
        rows = self._prepared(documents, True)
        missing = rows.join(self.resources, PAIR, "left_anti")
        if not missing.isEmpty():
            raise NotFound(str(missing.select(*PAIR).first()))
        old = self.resources.withColumnRenamed("uuid", "resource_uuid")
        kept = rows.drop("version_id").join(self.resources.select("uuid", "version_id"), "uuid")
        self._put(kept, log_ops.update_changes(old, rows, self.clock(), self._after()))

    def delete(self, ids: DataFrame) -> None:
        """Deletes by ``(resource_type, resource_id)`` and logs it; unknown ids are ignored."""
        gone = self.resources.join(ids.select(*PAIR), PAIR, "left_semi")
        self._remove(gone, {"log": self.log.unionByName(log_ops.delete_changes(gone.withColumnRenamed("uuid", "resource_uuid"), self.clock(), self._after()))})

    def _remove(self, gone: DataFrame, extra: dict[str, DataFrame]) -> None:
        self._commit({"resources": self.resources.join(gone.select(*PAIR), PAIR, "left_anti"), "index": self.index.join(gone.select("uuid"), "uuid", "left_anti"), **extra})

    def purge(self, ids: DataFrame, force: bool = False) -> None:
        """Removes resources without a deletion; refuses where local changes wait, unless forced, which drops them too."""
        missing = ids.join(self.resources, PAIR, "left_anti")
        if not missing.isEmpty():
            raise NotFound(str(missing.first()))
        if not force and not ids.join(self.log, PAIR, "left_semi").isEmpty():
            raise PendingChanges("local changes are not uploaded yet")
        self._remove(self.resources.join(ids.select(*PAIR), PAIR, "left_semi"), {"log": log_ops.discard_resources(self.log, ids)})

    def clear(self) -> None:
        self._commit({n: self.spark.createDataFrame([], s) for n, s in (("resources", RESOURCES), ("index", INDEX), ("log", log_ops.LOG), ("state", STATE))})

    # Reading.
    def get(self, resource_type: str, resource_id: str) -> str:
        found = self.resources.where((F.col("resource_type") == resource_type) & (F.col("resource_id") == resource_id)).select("json").first()
        if found is None:
            raise NotFound(f"{resource_type}/{resource_id}")
        return found["json"]

    def searchable(self) -> DocumentIndex:
        return DocumentIndex(self.resources, self.index, self.catalogue)

    def search(self, request: Search | str) -> DataFrame:
        index = self.searchable()
        return search(index, parse_query(index, request) if isinstance(request, str) else request)

    def count(self, request: Search | str) -> int:
        index = self.searchable()
        return count(index, parse_query(index, request) if isinstance(request, str) else request).first()["n"]

    def included(self, request: Search) -> DataFrame:
        return included(self.searchable(), request)

    def stitched(self, request: Search) -> DataFrame:
        return stitched(self.searchable(), request)

    def local_changes(self, resource_type: str, resource_id: str) -> DataFrame:
        return self.log.where((F.col("resource_type") == resource_type) & (F.col("resource_id") == resource_id)).orderBy("ts", "seq")

    # Synchronisation.
    def sync_download(self, pages: list[DataFrame], policy=accept_remote) -> None:
        """Applies pages of ``(json)``, one snapshot each: stores them, settles conflicts, drops settled changes."""
        for page in pages:

            def apply(store: Store, page: DataFrame = page) -> None:
                rows = store._prepared(page, False)
                clash = conflicts(rows, store.log)
                chosen = resolve(store.resources, rows, store.log, policy)
                again = chosen.where("conflict").select(*PAIR, "json")
                old = rows.withColumnRenamed("uuid", "resource_uuid")
                kept = log_ops.discard_resources(store.log, clash)
                mine = log_ops.update_changes(old, again, store.clock(), store._after())
                store._put(chosen.drop("conflict"), None, {"log": kept.unionByName(mine)})

            self.transaction(apply)
        self.set_state("last_sync", self.spark.range(1).select(self.clock().cast("string")).first()[0])

    def sync_upload(self, send: Callable[[DataFrame], DataFrame], strategy=None) -> DataFrame:
        """Sends the local changes in the order of their references and consolidates what succeeded; returns the answers.

        ``send`` gets the entries of one bundle (or of one level of single
        requests) and returns ``(resource_type, resource_id, ok, version_id,
        last_updated)``, and ``new_id`` where the server names resources itself.
        What is referred to goes out before what refers to it; groups that
        refer to each other stay in one bundle. Each bundle is one snapshot:
        its changes leave the log, versions and new ids come into documents,
        references and the rest of the log. After a bundle with a failure, or
        a missing answer, nothing more is sent, and the rest stays in the log.
        """
        from corvane.operators import ordering
        from corvane.operators.bundles import UploadStrategy, bundle_entries, pack_groups, single_requests

        strategy = strategy or UploadStrategy()
        patches = cut_lineage((log_ops.squash if strategy.squash else log_ops.per_change)(self.log))
        self._commit({"log": self._log_without(patches.where("type IS NULL"))})
        patches = patches.where("type IS NOT NULL")
        refs = patches.where("type <> 'DELETE'").select(*PAIR, F.explode(json_references("payload")).alias("r")).select(*PAIR, F.col("r.value").alias("value"))
        nodes = patches.select(ordering.node_name().alias("node")).distinct()
        groups = ordering.ordered_groups(nodes, ordering.insert_adjacency(patches, refs))
        sizes = patches.select(ordering.node_name().alias("node")).join(groups, "node").groupBy("level", "component").agg(F.count("*").alias("size"))
        if strategy.bundle:
            places = sizes.orderBy("level", "component").select("component", "size", F.monotonically_increasing_id().alias("position"))
            places = cut_lineage(places)
            bundles = pack_groups(places, strategy.bundle_size).join(places.select("component", "position"), "position").select("component", "bundle")
        else:
            bundles = sizes.select("component", F.col("level").alias("bundle"))
        dealt = patches.withColumn("node", ordering.node_name()).join(groups, "node").join(bundles, "component").drop("node", "component", "level")
        dealt = cut_lineage(dealt)
        answers = []
        for r in dealt.select("bundle").distinct().orderBy("bundle").toLocalIterator():
            own = dealt.where(F.col("bundle") == r["bundle"])
            if answers:  # ids that the server gave meanwhile are in the log and in these payloads
                own = self._renamed(own, answers)
            got = send((bundle_entries if strategy.bundle else single_requests)(own, strategy))
            got = cut_lineage(got if "new_id" in got.columns else got.withColumn("new_id", F.lit(None).cast("string")))
            answers.append(got)
            self._consolidate(own, got.where("ok"))
            if not own.join(got.where("ok"), PAIR, "left_anti").isEmpty():
                break
        return reduce(DataFrame.unionByName, answers) if answers else self.spark.createDataFrame([], "resource_type string, resource_id string, ok boolean, version_id string, last_updated timestamp, new_id string")

    def _log_without(self, patches: DataFrame) -> DataFrame:
        return log_ops.discard(self.log, patches.select("token")).select(*(c.split()[0] for c in log_ops.LOG.split(", ")))

    @staticmethod
    def _new_ids(good: DataFrame) -> DataFrame:
        return good.where("new_id IS NOT NULL AND new_id <> resource_id").select("resource_type", F.col("resource_id").alias("old_id"), "new_id")

    def _renamed(self, patches: DataFrame, answers: list[DataFrame]) -> DataFrame:
        ids = self._new_ids(reduce(DataFrame.unionByName, answers).where("ok"))
        return patches if ids.isEmpty() else cut_lineage(rewrite_log(patches.withColumn("seq", F.element_at("token", 1)), ids).drop("seq"))

    def _consolidate(self, sent: DataFrame, good: DataFrame) -> None:
        """One snapshot without the changes that succeeded, with the server's versions and ids."""
        names = [c.split()[0] for c in RESOURCES.split(", ")]
        tables = {"log": self._log_without(sent.join(good, PAIR, "left_semi")), "resources": with_server_meta(self.resources, good).select(*names)}
        ids = self._new_ids(good)
        if not ids.isEmpty():
            tables["log"] = rewrite_log(tables["log"], ids).select(*(c.split()[0] for c in log_ops.LOG.split(", ")))
            tables["resources"] = cut_lineage(rewrite_ids(tables["resources"], ids).select(*names))
            tables["index"] = index_documents(tables["resources"], self.catalogue)
        self._commit(tables)

    def get_state(self, key: str) -> str | None:
        found = self.state.where(F.col("key") == key).first()
        return found["value"] if found else None

    def set_state(self, key: str, value: str) -> None:
        self.set_states({key: value})

    def set_states(self, values: dict[str, str]) -> None:
        """Several keys in one snapshot; no other table is touched."""
        self._commit({"state": self.state.where(~F.col("key").isin(*values)).unionByName(self.spark.createDataFrame(list(values.items()), STATE))})

    def last_sync(self) -> str | None:
        return self.get_state("last_sync")


@dataclass(frozen=True)
class SyncResult:
    """How a synchronisation ended; ``errors`` is empty if it succeeded."""

    status: str
    errors: tuple[str, ...]
    downloaded: int
    uploaded: int


def run_sync(
    store: Store, pages: Iterable[DataFrame], send: Callable[[DataFrame], DataFrame], policy=accept_remote, strategy=None, progress: Callable[[str, int], None] | None = None, cancelled: Callable[[], bool] = lambda: False
) -> SyncResult:
    """Downloads page by page, then uploads. Errors of either half are gathered and do not stop the other half.

    ``progress`` hears of each page and answer, ``cancelled`` is asked before
    each page and before the upload. The outcome and the time are kept as the
    store's state, whatever happens; pages that were stored stay stored.
    """
    tell = progress or (lambda step, n: None)
    errors: list[str] = []
    down = up = 0
    stopped = False
    try:
        for page in pages:
            if stopped := cancelled():
                break
            store.sync_download([page], policy)
            down += 1
            tell("download", down)
    except Exception as e:  # noqa: BLE001  the upload still has its turn
        errors.append(f"download: {e}")
    stopped = stopped or cancelled()
    if not stopped:
        try:
            answers = store.sync_upload(send, strategy)
            up = answers.where("ok").count()
            tell("upload", up)
            errors += [f"upload: {r.resource_type}/{r.resource_id}" for r in answers.where("NOT ok").orderBy(*PAIR).limit(100).collect()]
            if not store.log.isEmpty() and not errors:
                errors.append("upload: changes without an answer are left")
        except Exception as e:  # noqa: BLE001  the outcome is kept
            errors.append(f"upload: {e}")
    status = "cancelled" if stopped else "failed" if errors else "succeeded"
    at = store.spark.range(1).select(store.clock().cast("string")).first()[0]
    store.set_states({"sync_status": status, "sync_errors": json.dumps(errors), "last_sync": at})
    return SyncResult(status, tuple(errors), down, up)
