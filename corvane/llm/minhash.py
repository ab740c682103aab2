"""One-permutation MinHash document fingerprints with optimal densification and b-bit packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import shuffle_width

BINS = 512
LOW_BITS = 4
SHINGLE_WORDS = 5
#: Rows of a stretch of neighbouring ids, and the most stretches whose bounds the driver holds.
STRETCH_ROWS, MAX_STRETCHES = 4096, 20_000

_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: For each bin the fixed order in which other bins are tried when it is empty, and the inverse.
_ORDER = np.stack([np.random.default_rng([7, j]).permutation(BINS) for j in range(BINS)]).astype(np.int16)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
_SALT = np.arange(BINS, dtype=np.uint64) * _STEP
_EMPTY = np.zeros(BINS, dtype=np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the text's word shingles (ASCII-lower-cased; fewer than ``k`` words: one shingle)."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = _mix((out + h[i : i + n]) * _STEP)
    return out


def signature(text: str | None) -> tuple[np.ndarray, bool]:
    """``BINS`` low-order codes and whether there is any shingle.

    Each shingle is hashed once: the top bits choose its bin, the rest is its
    value, a bin keeps the least. An empty bin copies the first filled bin in
    its own fixed random order (the same order for every document).
    """
    h = np.sort(shingle_hashes(text or ""))
    if not len(h):
        return _EMPTY, False
    bins = (h >> np.uint64(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    values = np.zeros(BINS, dtype=np.uint64)
    values[filled] = h[first]
    has = np.zeros(BINS, dtype=bool)
    has[filled] = True
    todo = np.flatnonzero(~has)
    if len(filled) >= 48:
        for t in range(0, BINS, 4):
            if not len(todo):
                break
            tried = _ORDER[todo, t : t + 4]
            ok = has[tried]
            hit = ok.any(axis=1)
            values[todo[hit]] = values[tried[hit, ok[hit].argmax(axis=1)]]
            todo = todo[~hit]
    elif len(todo):
        values[todo] = values[filled[_RANK[np.ix_(todo, filled)].argmin(axis=1)]]
    return (_mix(values + _SALT) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8), True


def packed(codes: np.ndarray) -> str:
    """Hexadecimal of the packed low-order codes: one digit for a code of four bits."""
    return (codes[0::2] << 4 | codes[1::2]).tobytes().hex()


def likeness(a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement of low-order codes.

    Two texts without words: 1. One of them without words: 0.
    """
    if not (a[1] and b[1]):
        return float(a[1] == b[1])
    chance = 1.0 / (1 << LOW_BITS)
    same = float(np.count_nonzero(a[0] == b[0])) / BINS
    return min(1.0, max(0.0, (same - chance) / (1.0 - chance)))


def likeness_of(fp_a: str, fp_b: str) -> float:
    """``likeness`` from two packed fingerprints; all zeros stands for no words."""
    unpack = lambda s: np.frombuffer(bytes.fromhex("".join(f"0{c}" for c in s)), dtype=np.uint8)
    a, b = unpack(fp_a), unpack(fp_b)
    return likeness((a, bool(a.any())), (b, bool(b.any())))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, fingerprint)`` for each row; null texts count as empty, null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            fps = [packed(signature(t)[0]) for t in texts]
            words = [len(t.encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(fps, pa.string())], ["doc_id", "n_words", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, fingerprint string")


def _stretch(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below ``key``, by binary search inside the JVM."""
    top = 1
    while top <= len(bounds):
        top *= 2
    padded = F.array(*(F.lit(b).cast("long") for b in bounds + [2**63 - 1] * (top - 1 - len(bounds))))
    steps = F.array(*(F.lit(top >> i) for i in range(1, top.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(padded, at + s) <= key, at + s).otherwise(at))


def in_id_order(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``(stretch, guard, doc_id, text)`` partitioned by stretch of neighbouring ids and sorted inside.

    Each stretch ends with a guard row: a copy of the first document of the
    next stretch (of the first stretch, after the last). So every document
    finds its successor in its own partition, texts move once, and nothing is
    ordered in a single task. Ties of an id are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    total = rows.count()
    n = max(1, min(MAX_STRETCHES, -(-total // stretch_rows)))
    cuts = []
    if n > 1:
        wanted = [i / n for i in range(1, n)]
        cuts = sorted(set(rows.select(F.percentile_approx(key, wanted, 20 * n).alias("c")).first()["c"]))
    placed = rows.withColumn("key", key).withColumn("stretch", _stretch(F.col("key"), cuts) if cuts else F.lit(0))
    lows = sorted((r["stretch"], r["low"]) for r in placed.groupBy("stretch").agg(F.min("key").alias("low")).collect())
    guards = [(low, lows[i - 1][0]) for i, (_, low) in enumerate(lows)]
    edge = spark.createDataFrame(guards, "low long, of int")  # a row for each stretch: at most MAX_STRETCHES + 1
    both = placed.join(F.broadcast(edge), F.col("key") == F.col("low"), "left").withColumn(
        "place",
        F.explode(
            F.when(F.col("of").isNull(), F.array(F.struct(F.col("stretch").alias("s"), F.lit(0).alias("g")))).otherwise(
                F.array(F.struct(F.col("stretch").alias("s"), F.lit(0).alias("g")), F.struct(F.col("of").alias("s"), F.lit(1).alias("g")))
            )
        ),
    )
    out = both.select(F.col("place.s").alias("stretch"), F.col("place.g").alias("guard"), "key", "doc_id", "text")
    out = out.repartition(shuffle_width(spark), "stretch").sortWithinPartitions("stretch", "guard", "key", "text")
    return out.select("stretch", "guard", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint_edits(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Fingerprints of each document and of its edited text, with likeness to both and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. "Next" is by ascending doc_id (nulls first, ties by
    text), after the last the first; a sole document is its own successor.
    Null texts are empty; repeated rows are separate documents; other columns
    are ignored; an empty table gives an empty result.
    """
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in fields.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the stretch, id, text and signature of the document that waits for its successor
        for batch in batches:
            rows = []
            for stretch, guard, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guard and (held is None or held[0] != stretch):
                    continue  # a tie of the guard's id: the first of them was the successor
                sig = signature(text)
                if held is not None and held[0] == stretch:
                    _, own_id, own, own_sig = held
                    edited = edited_text(own, text)
                    edited_sig = signature(edited) if edited != own else own_sig
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    rows.append((own_id, len(own), digest, packed(own_sig[0]), packed(edited_sig[0]), likeness(own_sig, edited_sig), likeness(own_sig, sig)))
                held = None if guard else (stretch, doc_id, text, sig)
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return in_id_order(docs, stretch_rows).mapInArrow(run, fields)
