"""Exact detection of repeated fixed-length token windows without a row for each window.

Every window of ``size`` tokens is owned by its anchor: the leftmost ``gram``-token
gram inside it with the least hash. The choice depends on the window's content
only, so equal windows have equal anchors at equal places. Consecutive windows of
a document with one anchor form a *segment*; a document has about
``2 / (size - gram + 2)`` segments a token. Two equal windows therefore lie either
in two segments with equal content (one *class*) or in two classes with the same
anchor. Classes are settled by their hashes alone; only classes that share an
anchor with another class go on to a comparison of their tokens (``needs``), one
occurrence of each. A plan with ``locate`` takes hashes as confirmation that
something recurs and no more: every occurrence of a recurring class, and of
classes that share an anchor, goes on with its tokens, and only what is found in
these counts (``located_ranges``).

Hot anchors are split up twice. A batch in which an anchor has very many different
segments sends every window of them under its own hashes, and only a mark under the
anchor; where a mark or very many classes meet, the anchor's other classes follow
as windows too. All windows of an anchor that is split up so meet by their hashes,
equal ones of a batch in one row, so no task gets all rows of a hot passage. Of a class
that recurs, a plan with ``locate`` sends the windows of the first occurrences and of one
repeat (``PROOF``): those of all others are equal, so these stay whole.

A text is told by its id and the hash of all of it, so that rows with one id and
unlike texts never lose each other's ranges. A window is a repeat if it also
starts earlier: at a smaller ``(doc, own, start)``, or, with ``strict``, in a
smaller ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, free_shuffles, shuffle_width

OCCURS, RANGE, NEED, HOT_NEED, WINDOW, MARK, REPEAT, WINDOW_REPEAT, PROOF = range(9)
ROWS = "kind byte, ah long, sh long, doc long, own long, s int, e int"
NAMES = ["kind", "ah", "sh", "doc", "own", "s", "e"]
NO_ID = -(2**63)
#: Tokens that are worked on at once; longer documents are taken in pieces.
PIECE = 1 << 20
#: Occurrences of one anchor that a task compares; above, its windows are dealt out by their own hashes.
HOT_ANCHOR = 4000
#: Tasks over which the rows of one anchor are dealt while its size is joined.
JOIN_SALTS = 32
#: Salt of a hot anchor's repeat that is not split into windows.
WHOLE = -1
#: Segments that are cut before they are handed on.
CUT_ROWS = 20_000
PARTS = "ah,salt,hot,doc,own,s,seg"
CUT = "ah long, salt int, hot boolean, doc long, own long, s int, seg binary"
#: Different segments of one anchor that a batch of rows sends to the anchor's task; above, it sends windows and a mark.
BATCH_ANCHOR = 32

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Plan:
    """Window and gram lengths in tokens, bytes or words, which earlier starts count, and whether tokens must confirm equal hashes."""

    size: int
    gram: int
    words: bool
    strict: bool
    locate: bool = False

    def tokens(self, data: bytes) -> np.ndarray:
        """The bytes of a text, or 64-bit hashes of its words."""
        if not self.words:
            return np.frombuffer(data, dtype=np.uint8)
        return np.array(list(map(xxhash.xxh3_64_intdigest, data.split())), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` tokens (a power of two) from each position; positions too near the end get none."""
    if tokens.dtype == np.uint8:
        if gram < 8 or len(tokens) < gram:
            h, width = _mix(tokens.astype(np.uint64) + _C), 1
        else:
            h, width = _mix(np.ndarray((len(tokens) - 7,), "<u8", tokens, strides=(1,)) + _C), 8
    else:
        h, width = _mix(tokens + _C), 1
    while width < gram:
        h = _mix(h[:-width] * _C + h[width:]) if len(h) > width else h[:0]
        width *= 2
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    block = np.full(rows * w, np.uint64(2**64 - 1))
    block[: len(x)] = x
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(tokens: np.ndarray, lengths: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """``(text, start, end, anchor, class)`` of the segments of texts laid end to end.

    ``start`` and ``end`` count tokens from the text's own begin.
    """
    w = plan.size - plan.gram + 1
    begins = np.cumsum(lengths) - lengths
    fits = lengths >= plan.size
    if not fits.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    least = sliding_min(g := gram_hashes(tokens, plan.gram), w)
    edge = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(edge, begins[fits], 1)
    np.add.at(edge, (begins + lengths - plan.size + 1)[fits], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (g[: len(least) - 1] == least[1:]) | ~valid[:-1]
    starts_here = np.zeros(len(least), dtype=bool)
    starts_here[begins[fits]] = True
    new = (new | starts_here) & valid
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    p, end = np.flatnonzero(new), np.flatnonzero(last) + plan.size
    text = np.searchsorted(begins, p, "right") - 1
    flat = memoryview(np.ascontiguousarray(tokens)).cast("B")
    u = tokens.itemsize
    digest = xxhash.xxh3_64_intdigest
    cls = np.fromiter((digest(flat[a:b]) for a, b in zip((p * u).tolist(), (end * u).tolist(), strict=True)), np.uint64, len(p))
    return text, p - begins[text], end - begins[text], least[p], cls


def merged(doc: np.ndarray, own: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges ``(doc, own, s, e)`` joined where they overlap or touch, by text."""
    order = np.lexsort((s, own, doc))
    doc, own, s, e = doc[order], own[order], s[order].astype(np.int64), e[order].astype(np.int64)
    if not len(doc):
        return doc, own, s, e
    other = np.zeros(len(doc), dtype=bool)
    other[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
    lift = np.cumsum(other) << 33
    top = np.maximum.accumulate(e + lift)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (s + lift)[1:] > top[:-1]
    at = np.flatnonzero(new)
    ends = top[np.append(at[1:], len(doc)) - 1] - lift[at]
    return doc[at], own[at], s[at], ends


def _rows(kind: int, ah, sh, doc, own, s, e) -> pa.RecordBatch:
    n = len(doc)
    as_long = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, dtype=np.int64))
    cols = [pa.array(np.full(n, kind, np.int8)), *map(as_long, (ah, sh, doc, own)), pa.array(np.asarray(s, np.int32)), pa.array(np.asarray(e, np.int32))]
    return pa.RecordBatch.from_arrays(cols, NAMES)


def _repeat_mask(new_class: np.ndarray, doc: np.ndarray, own: np.ndarray, s: np.ndarray, strict: bool) -> np.ndarray:
    first = np.maximum.accumulate(np.where(new_class, np.arange(len(doc)), 0))
    return doc > doc[first] if strict else (doc != doc[first]) | (own != own[first]) | (s != s[first])


def _spread(own: np.ndarray) -> np.ndarray:
    return _mix(own.astype(np.int64).view(np.uint64) + _C)


def combine(ah, sh, doc, own, s, e, plan: Plan, kind: int = OCCURS) -> Iterator[pa.RecordBatch]:
    """Settles classes inside one batch: repeats become ranges, first occurrences go on as ``kind``.

    With ``plan.locate`` a class's first repeat goes on too, which tells that it
    recurs; the others become ``REPEAT`` or ``WINDOW_REPEAT`` rows, with their anchor in ``sh``.
    """
    order = np.argsort(ah)
    a = ah[order]
    same = np.zeros(len(a), dtype=bool)
    same[1:] = a[1:] == a[:-1]
    same[:-1] |= same[1:]
    dup = order[same]
    dup = dup[np.lexsort((s[dup], own[dup], doc[dup], sh[dup], ah[dup]))]
    keep = np.ones(len(ah), dtype=bool)
    if len(dup):
        new = np.ones(len(dup), dtype=bool)
        new[1:] = (ah[dup[1:]] != ah[dup[:-1]]) | (sh[dup[1:]] != sh[dup[:-1]])
        gone = dup[_repeat_mask(new, doc[dup], own[dup], s[dup], plan.strict)]
        if plan.locate and len(gone):
            again = np.zeros(len(gone), dtype=bool)
            again[1:] = (ah[gone[1:]] == ah[gone[:-1]]) & (sh[gone[1:]] == sh[gone[:-1]])
            gone = gone[again]
        keep[gone] = False
        if plan.locate:
            yield _rows(WINDOW_REPEAT if kind == WINDOW else REPEAT, _spread(own[gone]), ah[gone], doc[gone], own[gone], s[gone], e[gone])
        else:
            d, o, rs, re = merged(doc[gone], own[gone], s[gone], e[gone])
            yield _rows(RANGE, _spread(o), np.zeros(len(d), np.int64), d, o, rs, re)
    yield _rows(kind, ah[keep], sh[keep], doc[keep], own[keep], s[keep], e[keep])


def _window_hashes(tokens: np.ndarray, size: int, first: int, last: int) -> tuple[list[int], list[int]]:
    """Two 64-bit hashes of each window that starts in ``[first, last]``."""
    flat, u = memoryview(np.ascontiguousarray(tokens)).cast("B"), tokens.itemsize
    both = [xxhash.xxh3_128_intdigest(flat[p * u : (p + size) * u]) for p in range(first, last + 1)]
    return [h >> 64 for h in both], [h & (2**64 - 1) for h in both]


def _as_windows(pieces: list[np.ndarray], piece, begin, end, doc, own, s, size: int) -> tuple[np.ndarray, ...]:
    """``(ah, sh, doc, own, s, e)`` of every window of segments, whose tokens are ``pieces[piece][begin:end]``."""
    high, low, docs, owns, starts = [], [], [], [], []
    for k, a, b, d, o, at in zip(*(x.tolist() for x in (piece, begin, end, doc, own, s)), strict=True):
        h, x = _window_hashes(pieces[k], size, a, b - size)
        high += h
        low += x
        docs += [d] * len(h)
        owns += [o] * len(h)
        starts += range(at, at + len(h))
    starts = np.array(starts, dtype=np.int64)
    return np.array(high, np.uint64), np.array(low, np.uint64), np.array(docs, np.int64), np.array(owns, np.int64), starts, starts + size


def _occurrences(plan: Plan, batch_anchor: int):
    def pieces(texts: pa.Array) -> Iterator[tuple[list, ...]]:
        held, docs, skips, size = [], [], [], 0
        for i, t in enumerate(texts):
            tokens = plan.tokens((t.as_py() or "").encode())
            if len(tokens) < plan.size:
                continue
            for at in range(0, len(tokens) - plan.size + 1, PIECE):  # windows that start in [at, at + PIECE)
                part = tokens[at : at + PIECE + plan.size - 1]
                held.append(part)
                docs.append(i)
                skips.append(at)
                size += len(part)
                if size >= PIECE:
                    yield held, docs, skips
                    held, docs, skips, size = [], [], [], 0
        if held:
            yield held, docs, skips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            found, kept = [], []
            for held, docs, skips in pieces(batch.column(2)):
                text, s, e, ah, sh = segments(np.concatenate(held), np.array([len(x) for x in held]), plan)
                at = np.array(skips)[text]
                row = np.array(docs, dtype=np.int64)[text]
                found.append((ah, sh, ids[row], owns[row], s + at, e + at, text + len(kept), s, e))
                kept += held
            if not found:
                continue
            ah, sh, doc, own, s, e, piece, begin, end = (np.concatenate(c) for c in zip(*found, strict=True))
            classes = np.unique(np.stack([ah, sh]), axis=1)[0] if len(ah) > batch_anchor else ah[:0]
            anchors, times = np.unique(classes, return_counts=True)
            hot = anchors[times > batch_anchor]
            if len(hot):
                split = np.isin(ah, hot)
                yield from combine(*_as_windows(kept, *(x[split] for x in (piece, begin, end, doc, own, s)), plan.size), plan, WINDOW)
                none = np.zeros(len(hot), np.int64)
                yield _rows(MARK, hot, np.full(len(hot), NO_ID), none, none, none, none)
                ah, sh, doc, own, s, e = (x[~split] for x in (ah, sh, doc, own, s, e))
            yield from combine(ah, sh, doc, own, s, e, plan)

    return run


def _settle(plan: Plan, windows: bool = False):
    """Streams rows sorted by (ah, sh, doc, own, s): repeats of a class become ranges, classes that share an anchor needs.

    Classes of an anchor with a mark become hot needs. ``windows``: the rows
    are windows under their own hashes, which have no needs. With ``plan.locate``
    repeats stay rows of their own, a class's first one (of each batch) as its
    proof, and the first occurrence of a class that recurs is needed too, that of
    a window included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # first occurrences of the last class
        told, mixed = False, False  # whether they were given out as needs; whether their anchor has other classes
        marked: int | None = None  # the last anchor with a mark; marks come first in an anchor
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            marks = cols[1][cols[0] == MARK]
            passed = np.isin(cols[0], (RANGE, REPEAT, WINDOW_REPEAT)) | ((cols[0] == WINDOW) & (not windows))
            for kind in np.unique(cols[0][passed]):
                mine = cols[0] == kind
                yield _rows(int(kind), *(c[mine] for c in cols[1:]))
            ah, sh, doc, own, s, e = (c[~passed & (cols[0] != MARK)] for c in cols[1:])
            hot_anchors = marks if marked is None else np.append(marks, marked)
            marked = int(marks[-1]) if len(marks) else marked
            if not len(ah):
                continue
            ghosts = 0
            if held is not None:
                ghosts = len(held[0])
                ah, sh, doc, own, s, e = (np.concatenate(x) for x in zip(held, (ah, sh, doc, own, s, e), strict=True))
            new_group = np.ones(len(ah), dtype=bool)
            new_group[1:] = ah[1:] != ah[:-1]
            new_class = new_group.copy()
            new_class[1:] |= sh[1:] != sh[:-1]
            gone = _repeat_mask(new_class, doc, own, s, plan.strict)
            gone[:ghosts] = False
            if gone.any() and plan.locate:
                proof = gone.copy()
                proof[1:] &= ~gone[:-1]  # a class begins with first occurrences, held ones included
                for kind, mine in ((WINDOW_REPEAT, gone),) if windows else ((REPEAT, gone & ~proof), (PROOF, proof)):
                    yield _rows(kind, np.zeros(mine.sum(), np.int64), *(x[mine] for x in (ah, doc, own, s, e)))
            elif gone.any():
                d, o, rs, re = merged(doc[gone], own[gone], s[gone], e[gone])
                yield _rows(RANGE, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, o, rs, re)
            at = np.flatnonzero(new_group)
            hot = np.isin(ah[at], hot_anchors)
            many = (np.add.reduceat(new_class.astype(np.int64), at) > 1) | hot
            if plan.locate:
                many |= np.logical_or.reduceat(gone, at)
            if ghosts and mixed:
                many[0] = True
            each = np.diff(np.append(at, len(ah)))
            need = np.repeat(many, each) & ~gone & (plan.locate or not windows)
            if ghosts and told:
                need[:ghosts] = False
            for kind, mine in ((NEED, need & ~np.repeat(hot, each)), (HOT_NEED, need & np.repeat(hot, each))):
                if mine.any():
                    yield _rows(kind, *(x[mine] for x in (ah, sh, doc, own, s, e)))
            begin = int(np.flatnonzero(new_class)[-1])
            stay = np.arange(begin, len(ah))[~gone[begin:]]
            mixed = told = bool(many[-1])
            stay = stay[:1] if told else stay
            held = tuple(x[stay] for x in (ah, sh, doc, own, s, e))

    return run


def _by_window(plan: Plan):
    """For hot anchors: every window of a segment under its own two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, own, s = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "own", "s"))
            if len(doc):
                pieces = [plan.tokens(x) for x in batch.column("seg").to_pylist()]
                none, end = np.zeros(len(doc), np.int64), np.array([len(x) for x in pieces])
                rows = _as_windows(pieces, np.arange(len(doc)), none, end, doc, own, s, plan.size)
                yield from combine(*rows, plan, WINDOW)

    return run


def _salt(doc: int, own: int, s: int, salts: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc} {own} {s}") % salts if salts > 1 else 0


def _cut(plan: Plan):
    """The tokens of needed segments, out of whole texts: bytes, or words joined by a space.

    Where an anchor is dealt over several salts, first occurrences go to each.
    Without ``salts`` a need keeps the salt ``WHOLE``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text, needs in zip(*batch.columns, strict=True):
                doc, own, data, needs = doc.as_py(), own.as_py(), text.as_py().encode(), needs.as_py()
                words = data.split() if plan.words else None
                for n in needs:
                    seg = data[n["s"] : n["e"]] if words is None else b" ".join(words[n["s"] : n["e"]])
                    for salt in range(n["salts"]) if n["first"] else [_salt(doc, own, n["s"], n["salts"]) if n["salts"] else WHOLE]:
                        out.append((n["ah"], salt, n["hot"], doc, own, n["s"], seg))
                    if len(out) >= CUT_ROWS:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], PARTS.split(","))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    n = shuffle_width(rows.sparkSession)
    return rows.repartition(n, "ah").sortWithinPartitions("ah", "sh", "doc", "own", "s")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc"), F.xxhash64(text).alias("own"), text.alias("text"))


def repeated_ranges(docs: DataFrame, plan: Plan, compare: Callable, hot_anchor: int = HOT_ANCHOR, batch_anchor: int = BATCH_ANCHOR) -> DataFrame:
    """``(doc, own, ranges array<struct<s, e>>)``: token ranges covered by repeated windows; texts without any are left out.

    ``compare`` is a ``mapInArrow`` function over ``(ah, hot, doc, own, s, seg)``
    rows, sorted by anchor, that returns ``(doc, own, s, e)`` ranges of windows
    that also start earlier in another row with the same anchor.
    """
    texts, key = _keyed(docs), ["doc", "own"]
    rows = cut_lineage(_dealt(texts.mapInArrow(_occurrences(plan, batch_anchor), ROWS)).mapInArrow(_settle(plan), ROWS))
    free_shuffles(docs.sparkSession)
    ranges = rows.where(F.col("kind") == RANGE).select(*key, "s", "e")
    needs = rows.where(F.col("kind").isin(NEED, HOT_NEED)).withColumn("marked", F.col("kind") == HOT_NEED)
    hot = needs.groupBy("ah").count().where(F.col("count") > hot_anchor).select("ah", F.lit(True).alias("hot"))
    needs = needs.join(hot, "ah", "left").select(*key, F.struct("ah", "s", "e", F.coalesce("hot", "marked").alias("hot"), F.lit(1).alias("salts"), F.lit(True).alias("first")).alias("n"))
    wanted = needs.groupBy(*key).agg(F.collect_set("n").alias("needs"))
    parts = texts.join(wanted, key).select(*key, "text", "needs").mapInArrow(_cut(plan), CUT)
    parts = cut_lineage(parts.dropDuplicates(["ah", "doc", "own", "s"]))
    free_shuffles(docs.sparkSession)
    cold = parts.where("not hot").repartition(shuffle_width(docs.sparkSession), "ah").sortWithinPartitions("ah", "doc", "own", "s")
    ranges = ranges.unionByName(cold.mapInArrow(compare, "doc long, own long, s int, e int"))
    loose = rows.where(F.col("kind") == WINDOW).unionByName(parts.where("hot").mapInArrow(_by_window(plan), ROWS))
    by_window = _dealt(loose).mapInArrow(_settle(plan, windows=True), ROWS)
    ranges = ranges.unionByName(by_window.where(F.col("kind") == RANGE).select(*key, "s", "e"))
    return ranges.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def _cut_runs(plan: Plan):
    """Runs of recurring windows as segments under their anchors: those of first occurrences, and those of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text, starts in zip(*batch.columns, strict=True):
                doc, own, data = doc.as_py(), own.as_py(), text.as_py().encode()
                words, starts = data.split() if plan.words else None, starts.as_py()
                for first in (True, False):
                    at = sorted(n["s"] for n in starts if n["first"] == first)
                    breaks = [k for k in range(1, len(at)) if at[k] != at[k - 1] + 1]
                    for a, b in zip([0, *breaks], [*breaks, len(at)], strict=True) if at else ():
                        begin, end = at[a], at[b - 1] + plan.size
                        tokens = plan.tokens(b" ".join(words[begin:end]) if plan.words else data[begin:end])
                        _, s, e, ah, _ = segments(tokens, np.array([len(tokens)]), plan)
                        for x, y, h in zip((s + begin).tolist(), (e + begin).tolist(), ah.view(np.int64).tolist(), strict=True):
                            out.append((h, first, doc, own, x, data[x:y] if words is None else b" ".join(words[x:y])))
            if out:
                yield _run_rows(out)

    return run


RUNS = "ah long, first boolean, doc long, own long, s int, seg binary"


def _run_rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["ah", "first", "doc", "own", "s", "seg"])


def _run_windows(plan: Plan):
    """Each window of runs under its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc, own, s, seg in zip(*(batch.column(n).to_pylist() for n in ("first", "doc", "own", "s", "seg")), strict=True):
                items = seg.split() if plan.words else seg
                hashes = np.array(_window_hashes(plan.tokens(seg), plan.size, 0, len(items) - plan.size)[0], np.uint64).view(np.int64).tolist()
                cut = (items[i : i + plan.size] for i in range(len(hashes)))
                yield _run_rows([(h, first, doc, own, s + i, b" ".join(x) if plan.words else x) for i, (h, x) in enumerate(zip(hashes, cut, strict=True))])

    return run


def _sized(rows: DataFrame, most: int, marked: str = "false") -> DataFrame:
    """``rows`` with ``salts``, over which its anchor is dealt, and ``hot``: it has more than ``most`` first occurrences, or a mark.

    Only anchors of more than ``most`` rows, or with a mark, are joined, each as
    ``JOIN_SALTS`` rows, so that no task gets all rows of one.
    """
    sizes = rows.groupBy("ah").agg(F.count("*").alias("n"), F.count_if("first").alias("classes"), F.max(F.expr(marked)).alias("m")).where((F.col("n") > most) | F.col("m"))
    sizes = sizes.select("ah", F.ceil(F.col("n") / most).cast("int").alias("salts"), (F.col("m") | (F.col("classes") > most)).alias("hot"))
    sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))).withColumn("part", F.col("part").cast("long"))
    joined = rows.withColumn("part", F.pmod(F.xxhash64("doc", "own", "s"), F.lit(JOIN_SALTS).cast("long"))).join(sizes, ["ah", "part"], "left").drop("part")
    return joined.withColumns({"hot": F.coalesce("hot", F.lit(False)), "salts": F.coalesce("salts", F.lit(1))})


def _occurring(texts: DataFrame, rows: DataFrame, plan: Plan, most: int) -> DataFrame:
    """The tokens of all first and repeated occurrences in settled ``rows``; ``hot`` ones are to be split into windows, but for the salt ``WHOLE``."""
    repeat = F.col("kind").isin(REPEAT, PROOF)
    told = rows.where(repeat | F.col("kind").isin(NEED, HOT_NEED)).select(
        F.when(repeat, F.col("sh")).otherwise(F.col("ah")).alias("ah"), "doc", "own", "s", "e", (~repeat).alias("first"), (F.col("kind") == HOT_NEED).alias("marked"), (F.col("kind") == REPEAT).alias("whole")
    )
    salts = F.when(F.col("hot"), F.when(F.col("whole"), 0).otherwise(1)).otherwise(F.col("salts"))
    need = F.struct("ah", "s", "e", "hot", salts.alias("salts"), "first")
    wanted = _sized(told, most, "marked").groupBy("doc", "own").agg(F.collect_set(need).alias("needs"))
    return texts.join(wanted, ["doc", "own"]).select("doc", "own", "text", "needs").mapInArrow(_cut(plan), CUT)


def _salted(runs: DataFrame) -> DataFrame:
    """Sized runs with their salt; first occurrences go to every salt of their anchor."""
    own = F.array(F.pmod(F.xxhash64("doc", "own", "s"), F.col("salts").cast("long")).cast("int"))
    return runs.withColumn("salt", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)))


def _dealt_parts(parts: DataFrame) -> DataFrame:
    """Parts by anchor and salt, in order, each once."""
    dealt = parts.select("ah", "salt", "doc", "own", "s", "seg").repartition(shuffle_width(parts.sparkSession), "ah", "salt")
    return dealt.dropDuplicates(["ah", "salt", "doc", "own", "s"]).sortWithinPartitions("ah", "salt", "doc", "own", "s")


def located_ranges(docs: DataFrame, plan: Plan, compare: Callable, hot_anchor: int, batch_anchor: int) -> DataFrame:
    """As ``repeated_ranges``, with every range from ``compare``, which gets all occurrences of what recurs.

    An anchor with more than ``hot_anchor`` occurrences is dealt over salts, each
    with the first occurrence of all its classes. One with more classes, or with a
    mark, is split into windows, and the runs of those that recur are its occurrences,
    as are the repeats that stay whole;
    where their first occurrences are still more, each window goes under its own hash.
    """
    texts, found = _keyed(docs), "doc long, own long, s int, e int"
    rows = cut_lineage(_dealt(texts.mapInArrow(_occurrences(plan, batch_anchor), ROWS)).mapInArrow(_settle(plan), ROWS))
    free_shuffles(docs.sparkSession)
    parts = cut_lineage(_occurring(texts, rows, plan, hot_anchor))
    free_shuffles(docs.sparkSession)
    loose = rows.where(F.col("kind") == WINDOW).unionByName(parts.where(f"hot and salt <> {WHOLE}").mapInArrow(_by_window(plan), ROWS))
    loose = loose.unionByName(rows.where(F.col("kind") == WINDOW_REPEAT))
    windows = _dealt(loose).mapInArrow(_settle(plan, windows=True), ROWS).select("doc", "own", F.struct("s", (F.col("kind") != WINDOW_REPEAT).alias("first")).alias("n"))
    wanted = windows.groupBy("doc", "own").agg(F.collect_set("n").alias("starts"))
    whole = parts.where(f"hot and salt = {WHOLE}").select("ah", F.lit(False).alias("first"), "doc", "own", "s", "seg")
    runs = cut_lineage(texts.join(wanted, ["doc", "own"]).select("doc", "own", "text", "starts").mapInArrow(_cut_runs(plan), RUNS).unionByName(whole))
    free_shuffles(docs.sparkSession)
    sized = _sized(runs, hot_anchor)
    single = _sized(sized.where("hot").select(*runs.columns).mapInArrow(_run_windows(plan), RUNS), hot_anchor)
    ranges = _dealt_parts(parts.where("not hot")).mapInArrow(compare, found)
    for more in (sized.where("not hot"), single):
        ranges = ranges.unionByName(_dealt_parts(_salted(more)).mapInArrow(compare, found))
    return ranges.groupBy("doc", "own").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def by_text(doc: list[int], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(doc, own)`` in order, as rows, and the number of each given one among them."""
    return np.unique(np.array([doc, own], dtype=np.int64).T.reshape(-1, 2), axis=0, return_inverse=True)


def ranges_batch(texts: np.ndarray, number: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Ranges of numbered texts as a batch for ``repeated_ranges``."""
    cols = [pa.array(texts[number, 0]), pa.array(texts[number, 1]), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["doc", "own", "s", "e"])


def spans_of(ranges: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by ``ranges`` inside ``[0, length)``."""
    out: list[list[int]] = []
    for s, e in sorted((r["s"], min(r["e"], length)) for r in ranges or ()):
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, plan: Plan, compare: Callable, hot_anchor: int = HOT_ANCHOR, batch_anchor: int = BATCH_ANCHOR) -> DataFrame:
    """``(doc_id, n_tokens, spans, kept)``: what is left of each text, and the token spans removed from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, ranges in zip(*batch.columns, strict=True):
                doc, data, ranges = doc.as_py(), text.as_py().encode(), ranges.as_py()
                items = data.split() if plan.words else data
                spans, at, kept = spans_of(ranges, len(items)), 0, []
                for s, e in [*spans, (len(items), len(items))]:
                    kept += items[at:s] if plan.words else [items[at:s]]
                    at = e
                out.append((None if doc == NO_ID else doc, len(items), [{"s": s, "e": e} for s, e in spans], (b" " if plan.words else b"").join(kept)))
            if out:
                types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_tokens", "spans", "kept"])

    found = (located_ranges if plan.locate else repeated_ranges)(docs, plan, compare, hot_anchor, batch_anchor)
    both = _keyed(docs).join(found, ["doc", "own"], "left").select("doc", "text", "ranges")
    return both.mapInArrow(run, "doc_id long, n_tokens long, spans array<struct<s: long, e: long>>, kept binary")
