"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Documents are dealt into shards by a hash of their ids. A shard places its
pieces longest first. Its open bins are ordered by residual room, and each
carries bitmaps of the sources and duplicate clusters inside. A piece goes to the
tightest bin that is compatible: the search starts at the successor of the
piece's length in residual order and goes on until a bin has neither the
piece's cluster nor its full share of the piece's source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, shuffle_width

SHARD_PIECES = 4096
PLACED = "doc_id long, piece int, start long, n_tokens long, bin_id long, offset long, source string, cluster long"


def best_fit(pieces: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each ``(length, source, cluster)``, in the given order.

    A bin takes at most one piece of a cluster and ``per_source`` of a source;
    a null source or cluster conflicts with nothing.
    """
    sources: dict[object, int] = {}
    clusters: dict[object, int] = {}
    residual: list[tuple[int, int]] = []
    planes: list[list[int]] = []
    held: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s = 1 << sources.setdefault(source, len(sources)) if source is not None else 0
        c = 1 << clusters.setdefault(cluster, len(clusters)) if cluster is not None else 0
        at = bisect_left(residual, (length, -1))
        while at < len(residual):
            b = residual[at][1]
            if not held[b] & c and not planes[b][-1] & s:
                break
            at += 1
        if at < len(residual):
            room, b = residual.pop(at)
        else:
            room, b = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        out.append((b, capacity - room))
        held[b] |= c
        for k in range(per_source):  # the k-th plane: sources with more than k pieces
            if not planes[b][k] & s:
                planes[b][k] |= s
                break
        insort(residual, (room - length, b))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, source, cluster)``: words of each text, and the hash of the text as its exact-copy cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            words = pa.array([len(d.split()) for d in data], pa.int64())
            marks = pa.array([xxhash.xxh3_64_intdigest(d) - 2**63 for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), words, batch.column(2), marks], ["doc_id", "n_tokens", "source", "cluster"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, source string, cluster long")


def pack(sized: DataFrame, capacity: int = 2048, per_source: int = 4, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Places ``sized(doc_id, n_tokens, source, cluster)``; a row for each piece of each document.

    Columns: doc_id, piece, start, n_tokens, bin_id, offset, source, cluster.
    Documents longer than ``capacity`` are cut into pieces of ``capacity``
    tokens and a rest. Documents without tokens (null counts too) take no room
    and have a null bin. Null sources and clusters never conflict; repeated
    rows are separate pieces; other columns are ignored; ties are ordered by
    cluster, id and piece, so the result is the same however rows arrive.
    """
    sized = cut_lineage(
        sized.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.greatest(F.col("n_tokens").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("n"),
            F.col("source").cast("string").alias("source"),
            F.col("cluster").cast("long").alias("cluster"),
        )
    )
    whole = F.when(F.col("n") > 0, F.ceil(F.col("n") / capacity)).otherwise(1)
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("n_tokens"), "source", "cluster")
    total = sized.agg(F.sum(whole)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))
    width = max(1, min(shards, 100 * shuffle_width(sized.sparkSession)))
    dealt = dealt.repartition(width, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "cluster", "doc_id", "piece", "source")
    names = ["doc_id", "piece", "start", "n_tokens", "source", "cluster", "shard"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    fields = [f.split()[0] for f in PLACED.split(", ")]

    def place(rows: list[tuple]) -> pa.RecordBatch:
        full = [r for r in rows if r[3]]
        found = iter(best_fit([(r[3], r[4], r[5]) for r in full], capacity, per_source))
        out = []
        for r in rows:
            b, offset = next(found) if r[3] else (None, 0)
            out.append((*r[:4], None if b is None else r[6] << 24 | b, offset, r[4], r[5]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[6] != held[0][6]:
                    yield place(held)
                    held = []
                held.append(row)
        if held:
            yield place(held)

    return dealt.select(*names).mapInArrow(run, PLACED)
