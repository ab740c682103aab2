"""Suffix-array deduplication by merging shard Burrows-Wheeler transforms.

The candidate segments that ``windows`` leaves are cut into shards. Each shard's
suffixes are sorted once and give its Burrows-Wheeler transform. The shards'
transforms are then merged by iterative interleave refinement: starting from
the plain concatenation, round ``h`` orders the suffixes of all shards by their
first ``h`` bytes, with one stable counting pass over the transform, and never
compares or sorts suffixes again. A boundary that first shows in round ``h``
marks a common prefix of ``h - 1`` bytes; after ``size`` rounds the stretches
without a boundary are the repeated intervals. Deduplication needs these only, so
it carries the rounds on inside the intervals that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.windows import BATCH_ANCHOR, HOT_ANCHOR, Plan, by_text, merged, ranges_batch, without_repeats

SHARD_BYTES = 256 << 10
MERGE_SHARDS = 8


def suffix_order(segs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, order, segment, offset)`` of the segments' suffixes, the empty ones included.

    ``text`` holds every byte plus one, and 0 behind each segment; ``order``
    lists its positions by suffix, equal suffixes by segment.
    """
    lengths = np.array([len(x) for x in segs])
    n = int(lengths.sum()) + len(segs)
    segment = np.repeat(np.arange(len(segs)), lengths + 1)
    offset = np.arange(n) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    left = lengths[segment] - offset
    text = np.zeros(n, dtype=np.uint8)
    text[left > 0] = np.frombuffer(b"".join(segs), dtype=np.uint8) + 1
    spread = np.zeros(n + 8 * len(segs), dtype=np.uint8)  # eight zeros behind each segment, for keys of eight bytes
    at = np.arange(n) + 7 * segment
    spread[at] = text
    key = np.ndarray((len(spread) - 7,), ">u8", spread, strides=(1,))[at].astype(np.uint64)
    width, longest = 8, int(lengths.max(initial=0))
    while True:
        order = np.argsort(key)
        by = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        if width > longest or rank.max(initial=0) == n - 1:
            break
        key = rank * np.int64(n + 1)
        ahead = np.flatnonzero(left >= width)
        key[ahead] += rank[ahead + width] + 1
        width *= 2
    return text, np.argsort(rank * np.int64(n) + np.arange(n)), segment, offset


def transform(text: np.ndarray, order: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the byte before each suffix, 0 before a whole segment."""
    return np.where(offset[order] == 0, 0, text[order - 1]).astype(np.uint8)


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """For each rank the rank of the suffix that begins one byte earlier, by one counting pass."""
    out = np.empty(len(bwt), dtype=np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def repeated_intervals(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(index, interval)``: suffixes of all shards that share ``depth`` bytes with another, and which of them together.

    The refinement of ``interleave``, carried on only inside intervals of two
    or more: a suffix whose first bytes are its own keeps them to itself
    whatever stands before it, so it can found no later interval.
    """
    starts = np.cumsum([0, *(len(t) for t in transforms)])
    bwt = np.concatenate(transforms)
    first = np.concatenate([last_to_first(t) + a for t, a in zip(transforms, starts, strict=False)])
    at, block = np.arange(len(bwt)), np.zeros(len(bwt), dtype=np.int32)
    for _ in range(depth):
        before = bwt[at]
        perm = np.argsort(before, kind="stable")
        perm = perm[np.count_nonzero(before == 0) :]  # what stands before a segment begins no suffix
        lead, last = before[perm], block[perm]
        edge = np.ones(len(perm) + 1, dtype=bool)
        edge[1:-1] = (lead[1:] != lead[:-1]) | (last[1:] != last[:-1])
        stay = ~(edge[:-1] & edge[1:])
        at = first[at[perm[stay]]]
        block = np.cumsum(edge[:-1], dtype=np.int32)[stay]
        if not len(at):
            break
    return at, block


def interleave(transforms: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of the shards' suffixes by their first ``depth`` symbols.

    Returns, for each merged rank, its index in the concatenated shard orders,
    and the common prefix with the rank before it (``depth``: at least that).
    ``ends``: the number of segments of each shard.
    """
    bwt = np.concatenate(transforms)
    n, m = len(bwt), sum(ends)
    src = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    empties = np.repeat(np.arange(len(transforms), dtype=np.uint8), ends)
    at = np.empty(n, dtype=np.int64)
    prefix = np.full(n, depth, dtype=np.int32)
    block = np.zeros(n, dtype=np.int32)
    for h in range(1, depth + 1):
        at[np.argsort(src, kind="stable")] = np.arange(n)
        before = bwt[at]
        perm = np.argsort(before, kind="stable")
        src, last, lead = src[perm], block[perm], before[perm]
        src[:m] = empties
        edge = np.ones(n, dtype=bool)
        edge[m + 1 :] = (lead[m + 1 :] != lead[m:-1]) | (last[m + 1 :] != last[m:-1])
        prefix[edge & (prefix == depth)] = h - 1
        block = np.cumsum(edge, dtype=np.int32)
        if block[-1] == n:
            break
    at[np.argsort(src, kind="stable")] = np.arange(n)
    return at, prefix


def repeats(segs: list[bytes], doc: np.ndarray, start: np.ndarray, size: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, ...]:
    """``(doc, s, e)`` of the ``size``-byte strings in ``segs`` that also start earlier in another of them."""
    shards, held, total = [], [], 0
    for k, seg in enumerate(segs):
        held.append(k)
        total += len(seg)
        if total >= shard_bytes:
            shards.append(held)
            held, total = [], 0
    if held:
        shards.append(held)
    transforms, where, offsets = [], [], []
    for ids in shards:
        text, order, segment, offset = suffix_order([segs[k] for k in ids])
        transforms.append(transform(text, order, offset))
        where.append(np.array(ids)[segment[order]])
        offsets.append(offset[order])
    at, block = repeated_intervals(transforms, size)
    segment, offset = np.concatenate(where)[at], np.concatenate(offsets)[at]
    d, s = doc[segment], start[segment] + offset
    order = np.lexsort((s, d, block))
    b, d, s = block[order], d[order], s[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = b[1:] != b[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
    gone = (d != d[first]) | (s != s[first])
    d, _, s, e = merged(d[gone], np.zeros(gone.sum(), np.int64), s[gone], s[gone] + size)
    return d, s, e


def _compare(size: int, shard_bytes: int):
    most = shard_bytes * MERGE_SHARDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, at = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            doc, own, s, seg = zip(*held, strict=True)
            texts, number = by_text(doc, own)
            yield ranges_batch(texts, *repeats(list(seg), number, np.array(s, dtype=np.int64), size, shard_bytes))

        for batch in batches:
            for ah, doc, own, s, seg in zip(*(batch.column(n).to_pylist() for n in ("ah", "doc", "own", "s", "seg")), strict=True):
                if total >= most and ah != at:  # anchors stay whole: equal strings share theirs
                    yield from flush()
                    held, total = [], 0
                at = ah
                held.append((doc, own, s, seg))
                total += len(seg)
        if held:
            yield from flush()

    return run


def remove_repeated_bytes(docs: DataFrame, size: int = 100, gram: int = 32, hot_anchor: int = HOT_ANCHOR, batch_anchor: int = BATCH_ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, spans, kept)`` for ``docs(doc_id, text)`` as UTF-8 bytes.

    Every byte covered by a ``size``-byte string that also starts earlier
    (smaller doc_id, or same document and earlier start) is removed; strings
    are judged on the input. Null texts are empty, null ids come before all
    others, other columns are ignored, an empty table gives an empty result.
    Rows repeated whole count as one document and all get its result. Rows
    that share an id but not a text are texts of their own, in the order of
    their hashes; each loses only what is repeated of itself.
    """
    return without_repeats(docs, Plan(size, gram, False, False), _compare(size, shard_bytes), hot_anchor, batch_anchor)
