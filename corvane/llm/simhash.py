"""SimHash near-duplicate detection by a binary-trie self-join.

Fingerprints within ``budget`` differing bits are linked. By the pigeonhole
principle two such fingerprints agree on at least one of ``budget + 1`` disjoint
bit blocks, so the trie is held once for each block rotated to the front; the
trie's roots are then the nodes whose leading block is equal, and all of them
can be joined on different machines. Below the roots, pairs of nodes are
traversed together, level by level, their differing bits accumulate, and a pair
is pruned as soon as its bits exceed the budget.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.graph import connected_components
from corvane.llm.minhash import shingle_hashes
from corvane.llm.warc import remove_folder
from corvane.session import cut_lineage, free_shuffles, shared_dir, shuffle_width, stored

SEED = 42
#: Rows of one trie root that a task takes; larger roots are split a few bits deeper.
ROOT_ROWS = 20_000
#: Rows that a task joins at once; whole roots only.
CHUNK_ROWS = 200_000
STEP_BITS = 6


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit fingerprint of a whole text: ASCII-lower-cased words, repeated shingles counted.

    Fewer words than a shingle: the whole sequence is the one shingle. No
    words (null, empty, white space): 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k, h, glue = words_per_shingle, xxhash.xxh64_intdigest, b" ".join
    if len(words) <= k:
        return h(glue(words), SEED)
    hashes = np.array([h(glue(t), SEED) for t in zip(*(words[i:] for i in range(k)), strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit fingerprint for each row, repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), words_per_shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: F.Column, r: int) -> F.Column:
    return fp if r == 0 else F.shiftleft(fp, r).bitwiseOR(F.shiftrightunsigned(fp, 64 - r))


def _pairs(budget: int) -> F.Column:
    """For a row's next ``STEP_BITS`` bits ``s``: ``(lo, hi, diff)`` of each node pair in which it takes part."""
    masks = [m for m in range(1 << STEP_BITS) if m.bit_count() <= budget]
    return F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count()).alias("d")) for m in masks))


def _roots(fps: DataFrame, budget: int, root_rows: int) -> DataFrame:
    """``(rot, depth, lo, hi, v)``: each rotated fingerprint under the node pairs where its partners can be."""
    block = 64 // (budget + 1)
    turns = F.explode(F.array(*(F.struct(F.lit(i).alias("rot"), _rotated(F.col("fp"), i * block).alias("v")) for i in range(budget + 1))))
    rows = fps.select(turns.alias("x")).select("x.*")
    lead = F.shiftrightunsigned("v", 64 - block)
    rows = rows.select("rot", F.lit(block).alias("depth"), lead.alias("lo"), lead.alias("hi"), "v")
    key = ["rot", "depth", "lo", "hi"]
    done: list[DataFrame] = []
    depth = block
    while True:
        hot = rows.groupBy(*key).count().where(F.col("count") > root_rows).select(*key)
        if depth + STEP_BITS > 60 or hot.isEmpty():
            break
        hot = cut_lineage(hot)
        done.append(rows.join(hot, key, "left_anti"))
        wide, s = rows.join(hot, key), F.shiftrightunsigned(F.shiftleft("v", depth), 64 - STEP_BITS)
        wide = wide.withColumn("own", F.shiftrightunsigned("v", 64 - depth)).withColumn("s", s)
        wide = wide.withColumn("p", F.explode(_pairs(budget)))
        mine = F.shiftleft("own", STEP_BITS).bitwiseOR(F.col("s"))
        across = F.when(F.col("own") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        theirs = F.shiftleft(across, STEP_BITS).bitwiseOR(F.col("s").bitwiseXOR(F.col("p.mask").cast("long")))
        spent = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) + F.col("p.d")
        depth += STEP_BITS
        rows = cut_lineage(
            wide.where(spent <= budget).select(
                "rot", F.lit(depth).alias("depth"), F.least(mine, theirs).alias("lo"), F.greatest(mine, theirs).alias("hi"), "v"
            )
        )
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _close(v: np.ndarray, roots: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into sorted ``v`` within the budget, below ``roots``: rows of (depth, lo, hi)."""
    left, right = [], []
    for depth in np.unique(roots[:, 0]):
        own = roots[roots[:, 0] == depth]
        down = np.uint64(64 - int(depth))
        lo, hi = own[:, 1].astype(np.uint64), own[:, 2].astype(np.uint64)
        span = lambda p, down=down: (np.searchsorted(v, p << down), np.searchsorted(v, (p << down) | ((np.uint64(1) << down) - np.uint64(1)), "right"))
        (a0, a1), (b0, b1) = span(lo), span(hi)
        spent = np.bitwise_count(lo ^ hi).astype(np.int64)
        for bit in range(63 - int(depth), -2, -1):
            same = a0 == b0
            keep = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~(same & (a1 - a0 < 2))
            a0, a1, b0, b1, spent, same = (x[keep] for x in (a0, a1, b0, b1, spent, same))
            if not len(a0):
                break
            few = (a1 - a0) * (b1 - b0) <= 16 if bit >= 0 else np.ones(len(a0), bool)
            if few.any():  # leaves: the remaining bits at once
                na, nb = (a1 - a0)[few], (b1 - b0)[few]
                n = na * nb
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(nb, n)
                i, j = np.repeat(a0[few], n) + at // wide, np.repeat(b0[few], n) + at % wide
                ok = (np.bitwise_count(v[i] ^ v[j]) <= budget) & (~np.repeat(same[few], n) | (i < j))
                left.append(i[ok])
                right.append(j[ok])
                a0, a1, b0, b1, spent, same = (x[~few] for x in (a0, a1, b0, b1, spent, same))
                if not len(a0):
                    break
            one = np.uint64(1) << np.uint64(bit)
            up = np.uint64(bit + 1) if bit < 63 else None

            def middle(x0: np.ndarray, x1: np.ndarray, one=one, up=up) -> np.ndarray:
                head = v[x0] >> up << up if up is not None else np.zeros(len(x0), np.uint64)
                return np.clip(np.searchsorted(v, head | one), x0, x1)

            am, bm = middle(a0, a1), middle(b0, b1)
            cross = ~same
            a0, a1, b0, b1, spent = (
                np.concatenate(x)
                for x in (
                    (a0, am, a0, am[cross]),
                    (am, a1, am, a1[cross]),
                    (b0, bm, bm, b0[cross]),
                    (bm, b1, b1, bm[cross]),
                    (spent, spent, spent + 1, spent[cross] + 1),
                )
            )
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _join_roots(budget: int):
    block = 64 // (budget + 1)

    def solve(rot: int, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        v = np.unique(rows[:, 3].view(np.uint64))
        roots = np.unique(rows[:, :3], axis=0)
        i, j = _close(v, roots, budget)
        if not len(i):
            return []
        label = _forest(len(v), i, j)
        moved = np.flatnonzero(label != np.arange(len(v)))
        r = np.uint64(rot * block)
        back = lambda x: x if rot == 0 else (x >> r) | (x << (np.uint64(64) - r))
        return [(back(v[moved]).view(np.int64), back(v[label[moved]]).view(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for rot in np.unique(rows[:, 0]):
                for a, b in solve(int(rot), rows[rows[:, 0] == rot][:, 1:]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            count += batch.num_rows
            if count >= CHUNK_ROWS:  # cut where the last root begins
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from flush(rows[:cut])
                held, count = [rows[cut:]], len(rows) - cut
        if held:
            yield from flush(np.concatenate(held))

    return run


def near_edges(fps: DataFrame, budget: int = 2, root_rows: int = ROOT_ROWS) -> DataFrame:
    """``(a, b)`` over distinct fingerprints ``fp``: a spanning forest of all links of each joined root.

    No link between different fingerprints is lost: two linked fingerprints
    are connected by returned edges. Not every pair of a group is emitted.
    """
    spark = fps.sparkSession
    rows = _roots(fps.select("fp").distinct(), budget, root_rows)
    dealt = rows.repartition(shuffle_width(spark), "rot", "depth", "lo", "hi").sortWithinPartitions("rot", "depth", "lo", "hi")
    return dealt.mapInArrow(_join_roots(budget), "a long, b long").distinct()


def near_components(docs: DataFrame, budget: int = 2, words_per_shingle: int = 3, root_rows: int = ROOT_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, class_id)`` for each row of ``docs(doc_id, text)``.

    ``fingerprint`` is 16 hex digits. ``class_id`` is the smallest doc_id with
    the same fingerprint, ``component_id`` the smallest doc_id reachable over
    links. Null and empty texts have fingerprint zero and link like any other;
    null ids keep their row and never serve as a component's name unless the
    component has no other id; repeated rows are all returned; other columns
    of ``docs`` are not read; an empty table gives an empty result.
    """
    marks = cut_lineage(fingerprints(docs, words_per_shingle))
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    linked = connected_components(near_edges(classes, budget, root_rows))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "class_id", F.coalesce("component", "fp").alias("root")
    )
    named = cut_lineage(named)
    lows = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(lows, "root").select("fp", "class_id", "component_id")
    return marks.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "class_id",
    )


#: One document in so many shows which shingles are common; at most so many of them are told to the tasks.
SAMPLE, COMMON = 32, 1 << 18
#: Pairs left in all buckets that are compared at once; above, so many times more documents of a bucket take their turn in each round.
PAIRS, FASTER = 2_000_000, 8
#: Bits that tell the tasks which documents are in some pair. A fixed size: when they are full, more documents than needed are sent.
MARKED_BITS = 1 << 23
NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("id"), F.col("text").cast("string").alias("text"))


def _same(text: str) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode().lower().split())) - 2**63


def common_shingles(docs: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the documents, ascending, and their ranks, the rarest first.

    They only set the order in which shingles are looked up. Any one order
    finds all pairs; with common shingles last, few others come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(t or "", words_per_shingle)) for t in batch.column(1).to_pylist()]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = _keyed(docs).where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long")
    often = rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON)
    h = often.select("h").toArrow().column("h").to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], (len(h) - 1 - by).astype(np.int32)


def looked_up(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a document of which any document of that similarity has at least one among its own.

    Both share at least ``similarity`` of the document's shingles, so the first
    of these, in an order that holds for all documents, is among the first
    ``n - ceil(similarity * n) + 1`` of either (prefix filter). ``hashes`` are
    distinct and ascending.
    """
    n = len(hashes)
    if not n:
        return hashes
    known, ranks = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, ranks[at], -1)
        hashes = hashes[np.argsort(rank, kind="stable")]
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def parity_bits(hashes: np.ndarray) -> bytes:
    """For each of ``2**k`` places, about as many as there are hashes, whether an odd number of the hashes lead there."""
    n = max(64, 1 << max(0, len(hashes) - 1).bit_length())
    places = (hashes >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=n) & 1).astype(bool)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A number of elements that are in one of two sets only, at least: places of unlike parity.

    An element in both sets changes neither; one in a single set changes one
    place. The finer bits are folded onto the coarser ones, which keeps that.
    """
    a, b = sorted((np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)), key=len)
    return int(np.count_nonzero(a ^ np.bitwise_xor.reduce(b.reshape(len(a), -1), axis=1)))


def _maybe_alike(similarity: float):
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            far = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(far <= size * most + 1e-9))

    return run


def _sketches(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float, words_per_shingle: int) -> DataFrame:
    """``(id, same, fp, n, bits, looks)`` of each row; ``same`` identifies a sequence of words, ``n`` counts its shingles, ``bits`` are their parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            same = pa.array([_same(t) for t in texts], pa.int64())
            fps = pa.array(np.array([simhash(t, words_per_shingle) for t in texts], dtype=np.uint64).view(np.int64))
            held = [np.unique(shingle_hashes(t, words_per_shingle)) for t in texts]
            n = pa.array([len(h) for h in held], pa.int64())
            looks = pa.array([looked_up(h, common, similarity).view(np.int64) for h in held], pa.list_(pa.int64()))
            bits = pa.array([parity_bits(h) for h in held], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, fps, n, bits, looks], ["id", "same", "fp", "n", "bits", "looks"])

    return _keyed(docs).mapInArrow(run, "id long, same long, fp long, n long, bits binary, looks array<long>")


def marked(keys: DataFrame, bits: int = MARKED_BITS) -> bytes:
    """A bitmap of ``bits`` places with one for each long in the only column, gathered in slices of bounded size."""
    place = F.pmod(keys[keys.columns[0]], F.lit(bits))
    slices = keys.select(F.shiftright(place, 16).alias("slice"), (place % 65536).cast("int").alias("at")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                held.setdefault(int(k), np.zeros(65536, dtype=bool))[x] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([np.packbits(x).tobytes() for x in held.values()])], ["slice", "bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in slices.repartition(shuffle_width(keys.sparkSession), "slice").mapInArrow(run, "slice long, bits binary").toLocalIterator():
        out[r["slice"] * 8192 : (r["slice"] + 1) * 8192] |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, same: DataFrame, words_per_shingle: int) -> DataFrame:
    """``(same, h)``: the shingles, ascending, of texts among which are all in the only column of ``same``."""
    sent = docs.sparkSession.sparkContext.broadcast(marked(same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        for batch in batches:
            names, sets = [], []
            for t in batch.column(0):
                text = t.as_py() or ""
                name = _same(text)
                if wanted[name % len(wanted)]:
                    names.append(name)
                    sets.append(np.unique(shingle_hashes(text, words_per_shingle)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["same", "h"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "same long, h binary").dropDuplicates(["same"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct shingles; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(h, np.uint64) for h in batch.column(n).to_pylist()] for n in ("x", "y"))
            ok = pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    return run


def _apart(df: DataFrame, key: str) -> DataFrame:
    """Hide an aggregate's partitioning, so that AQE can split a hot key's side of the join."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _links(pairs: DataFrame, own: DataFrame, docs: DataFrame, similarity: float, words_per_shingle: int, folder: str) -> DataFrame:
    """``(a, b)`` of the pairs that are alike by all their shingles.

    Pairs that differ too much by their parity bits, which never says so of a
    pair that is alike, go first, so that shingles move for few others.
    """
    a = own.select(F.col("same").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    b = own.select(F.col("same").alias("b"), "n", F.col("bits").alias("y"))
    fit = pairs.where("a <> b").distinct().join(a, "a").join(b, "b").where(_length_fits(similarity))
    pairs = stored(fit.select("a", "b", "m", "n", "x", "y").mapInArrow(_maybe_alike(similarity), "a long, b long"), folder)
    x = _sets(docs, pairs.select("a"), words_per_shingle).withColumnsRenamed({"same": "a", "h": "x"})
    y = _sets(docs, pairs.select("b"), words_per_shingle).withColumnsRenamed({"same": "b", "h": "y"})
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_alike(similarity), "a long, b long"), folder)


def _length_fits(similarity: float) -> F.Column:
    """Sets of ``m`` and ``n`` shingles can be that similar."""
    return F.least("m", "n") >= F.greatest("m", "n") * similarity - 1e-9


def _across(shared: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``(p, same, n, hub, root, rows, most)`` of the buckets that hold several components.

    ``most`` is the component of the documents marked ``hub``, or where none is, the
    largest one; its documents are the marked ones of the result. So a document that is
    in it stays in it, whichever component becomes the largest later.
    """
    named = shared.join(_apart(connected_components(links), "node"), F.col("same") == F.col("node"), "left")
    named = named.select("p", "same", "n", "hub", F.coalesce("component", "same").alias("root"))
    counts = named.groupBy("p", "root").agg(F.count("*").alias("c"), F.max("hub").alias("h"))
    split = counts.groupBy("p").agg(F.count("*").alias("roots"), F.sum("c").alias("rows"), F.max_by("root", F.struct("h", "c", "root")).alias("most"))
    both = named.join(_apart(split.where("roots > 1"), "p").drop("roots"), "p")
    return stored(both.withColumn("hub", F.col("root") == F.col("most")), folder)


def near_groups(docs: DataFrame, similarity: float = 0.8, budget: int = 3, words_per_shingle: int = 5) -> DataFrame:
    """``(id, same, group_id)`` by row: the components of all links of ``similarity`` of the word shingles or more.

    Candidates are documents whose whole fingerprints are within ``budget``
    bits (trie self-join) or that have a shingle in common among those that
    they look up; the latter misses no link. Each candidate that neither sizes
    nor parity bits rule out, which they do for certain, is verified by all
    its shingles. In a bucket of one shingle all documents are first held
    against one; then those in different components against each other, round
    by round if they are many, until all pairs of a bucket are in one component
    or have been compared. So a large group of copies costs no square of its
    size. Equal sequences of words count once. ``group_id`` is the smallest id
    of the group; null ids come before all others; texts without words are one
    group.
    """
    folder = f"{shared_dir(docs.sparkSession)}/near-{uuid.uuid4().hex}"
    rows = stored(_sketches(docs, common_shingles(docs, words_per_shingle), similarity, words_per_shingle), folder)
    own = stored(rows.groupBy("same").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.max("bits").alias("bits")), folder)
    looks = rows.select("same", "n", F.explode("looks").alias("p"))
    heads = looks.groupBy("p").agg(F.min("same").alias("head"), F.max("same").alias("other")).where("head < other").select("p", "head")
    heads = stored(heads, folder)
    free_shuffles(docs.sparkSession)
    shared = stored(looks.join(_apart(heads, "p"), "p").select("p", "same", "n", "head").distinct(), folder)
    free_shuffles(docs.sparkSession)
    by_fp = own.groupBy("fp").agg(F.min("same").alias("b"))
    near = near_edges(by_fp, budget).withColumnRenamed("a", "fp").join(by_fp.withColumnRenamed("b", "a"), "fp").select("a", F.col("b").alias("fp"))
    near = near.join(by_fp, "fp").select("a", "b")
    equal = own.select(F.col("same").alias("a"), "fp").join(_apart(by_fp, "fp"), "fp").select("a", "b")
    first = near.unionByName(equal).unionByName(shared.select(F.col("same").alias("a"), F.col("head").alias("b"))).where("a <> b").distinct()
    links = _links(first, own, docs, similarity, words_per_shingle, folder)
    left = shared.drop("head").withColumn("hub", F.lit(False))
    done, turns = 0, FASTER
    while True:
        # A bucket that is in one component stays so and is not read again.
        left = _across(left.select("p", "same", "n", "hub"), links, folder)
        # At least one document of a pair is outside the bucket's hub, its largest component in the first round.
        # They take their turns in the order of a hash, about ``turns`` of a bucket before the mark.
        share = (F.xxhash64("same") / F.lit(2.0**64) + 0.5) * F.col("rows")
        few = left.where(~F.col("hub") & (share >= done))
        total = few.agg(F.sum("rows")).first()[0] or 0
        if not total:
            break
        last = total <= PAIRS
        mine = few if last else few.where(share < turns)
        mine = mine.select("p", F.col("same").alias("a"), F.col("n").alias("m"), F.col("root").alias("own"))
        pairs = mine.join(left.select("p", F.col("same").alias("b"), "n", "root"), "p")
        pairs = pairs.where((F.col("own") != F.col("root")) & _length_fits(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = links.unionByName(_links(pairs, own, docs, similarity, words_per_shingle, folder))
        done, turns = turns, turns * FASTER
        if last:
            break
        # All documents of a bucket with fewer rows than ``done`` have had their turn.
        left = left.where(F.col("rows") >= done)
    linked = connected_components(links)
    named = own.select("same", "id").join(linked, F.col("same") == F.col("node"), "left").select("same", "id", F.coalesce("component", "same").alias("root"))
    named = cut_lineage(named)
    rows = cut_lineage(rows.select("id", "same"))
    remove_folder(docs.sparkSession, folder)
    lows = named.groupBy("root").agg(F.min("id").alias("group_id"))
    named = named.join(lows, "root").select("same", "group_id")
    return rows.join(named, "same")


def keep_one(docs: DataFrame, similarity: float = 0.8, budget: int = 3, words_per_shingle: int = 5) -> DataFrame:
    """Rows of ``docs`` that stay: of each group of near duplicates the document with the smallest id.

    A null id counts as the smallest; rows that repeat the smallest id of a
    group all stay; other columns pass through; an empty table stays empty.
    """
    groups = near_groups(docs, similarity, budget, words_per_shingle)
    kept = groups.where("id = group_id").select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID).cast("long")) == F.col("__kept"), "left_semi")
