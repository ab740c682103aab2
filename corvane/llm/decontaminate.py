"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Edit distance is over words (``\\w+``, lower-cased). A window of a document has as
many words as the item it is held against (a shorter document is one window).
It is a leak if its edit distance to the item is at most ``1 - similarity`` of
the item's words.

* Which windows: by the pigeonhole principle, an item cut into one piece more
  than the allowed edits leaves one piece unchanged. Windows around the places
  where a piece of an item occurs are therefore all that can match; finding
  them is exact and loses nothing. Without it every window of every length
  would be embedded, which costs hundreds of times as much. It does not say
  which item a window is held against: that is left to the LSH.
* CGK: a random walk reads a window word by word, repeating or advancing by a
  random bit of (step, word), and maps edit distance to Hamming distance.
* LSH: several independent walks, each with hash tables over sampled positions.
  The number of walks is set for each item length by simulation on the items
  themselves at the full error budget; walks are added until the target recall
  is reached.
* Every candidate pair is verified by the exact edit distance.

Memory does not grow with the number of matches: texts are searched in pieces
of ``CHUNK_WORDS``, equal windows of a piece are embedded and verified once, and
pairs are marked in a grid of at most ``GRID`` windows and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

WORD, SPACE = re.compile(r"\w+"), re.compile(r"\s")
#: Items, and words of items, of one pass over the documents; larger benchmarks take several passes, one after another.
BLOCK_ITEMS, BLOCK_WORDS = 2_000, 400_000
#: Words of documents that are searched at once; longer documents are taken in overlapping pieces.
CHUNK_WORDS = 250_000
#: Characters that are split into words at once.
SLICE = 1 << 20
#: Window starts, cells of windows and items, and matches that are held at once.
SPOTS, GRID, SPREAD = 500_000, 2_000_000, 500_000
SAMPLED, TABLES = 3, 24
FOUND = "doc_id long, item_id long, start long, distance int, similarity double"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TURN = pow(int(_A), -1, 2**64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, cut at white space into slices, so that no list of all words is held."""
    text, at, out = text or "", 0, []
    while at < len(text):
        gap = SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        words = WORD.findall(text[at:end].lower())
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def edit_distances(items: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact edit distance of each row's item to the first ``lengths`` words of its window."""
    rows, m = windows.shape
    cells = np.arange(m + 1, dtype=np.int32)
    row = np.broadcast_to(cells, (rows, m + 1))
    for i in range(items.shape[1]):
        new = np.empty((rows, m + 1), dtype=np.int32)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (items[:, i : i + 1] != windows), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - cells, axis=1) + cells
    return row[np.arange(rows), lengths].astype(np.int64)


def bit_distances(items: np.ndarray, item: np.ndarray, windows: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact edit distances of pairs ``(item, row)`` for items of up to 64 words, a column of cells in one machine word.

    The bit-vector recurrence over vertical differences, for all pairs at once.
    """
    n = items.shape[1]
    known = np.unique(items)
    marks = np.zeros((len(items), len(known) + 1), dtype=np.uint64)
    place = np.searchsorted(known, items)
    for i in range(n):
        marks[np.arange(len(items)), place[:, i]] |= np.uint64(1 << i)
    some, row = np.unique(row, return_inverse=True)
    windows, size = windows[some], lengths[some][row]
    at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
    word = np.where(known[at] == windows, at, len(known))
    one, top = np.uint64(1), np.uint64(n - 1)
    up, down = np.full(len(item), np.uint64((1 << n) - 1)), np.zeros(len(item), np.uint64)
    score = np.full(len(item), n, dtype=np.int64)
    for j in range(windows.shape[1]):
        same = marks[item, word[row, j]]
        flat = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(flat | up), up & flat
        score += np.where(j < size, ((rise >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64), 0)
        rise, fall = (rise << one) | one, fall << one
        up, down = fall | ~((same | down) | rise), rise & (same | down)
    return score


def embed(windows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """CGK: three words a word of each window, read by one random walk; 0 behind a window's end."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at, every = np.zeros(rows, dtype=np.int64), np.arange(rows)
    out = np.empty((rows, 3 * n), dtype=np.uint64)
    for j in range(3 * n):
        out[:, j] = x = padded[every, at]
        step = (_mix(x + np.uint64((walk * 1_000_003 + j + 1) * int(_B) % 2**64)) & np.uint64(1)).astype(np.int64)
        at = np.minimum(at + step, lengths)
    return out


def table_keys(embedded: np.ndarray, n: int, walk: int) -> np.ndarray:
    """``(rows, TABLES)`` hashes of each table's sampled positions, for windows of ``n`` words."""
    width = 3 * n
    pick = np.random.default_rng([walk, width]).integers(0, width, (TABLES, SAMPLED))
    out = np.zeros((len(embedded), TABLES), dtype=np.uint64)
    for k in range(SAMPLED):
        out = _mix(out + embedded[:, pick[:, k]] + np.uint64(k + 1))
    return out


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """An item-sized window ``edits`` random word edits away from ``words``: substitutions, and moves of a gap."""
    out = words.tolist()
    while edits > 0:
        if edits >= 2 and rng.random() < 0.5:
            out.pop(int(rng.integers(len(out))))
            out.insert(int(rng.integers(len(out) + 1)), int(rng.integers(2**63)))
            edits -= 2
        else:
            out[int(rng.integers(len(out)))] = int(rng.integers(2**63))
            edits -= 1
    return np.array(out, dtype=np.uint64)


def walks_for(items: np.ndarray, budget: int, recall: float, tries: int = 500) -> int:
    """Walks that find the wanted share of windows at the full budget, on ``tries`` simulated ones of one item length."""
    n = items.shape[1]
    rng = np.random.default_rng([11, n])
    own = items[rng.integers(len(items), size=tries)]
    far = np.stack([_edited(w, budget, rng) for w in own])
    walk = 0
    while True:
        size = np.full(len(own), n)
        hit = (table_keys(embed(own, size, walk), n, walk) == table_keys(embed(far, size, walk), n, walk)).any(axis=1)
        own, far, walk = own[~hit], far[~hit], walk + 1
        if len(own) <= (1 - recall) * tries:
            return walk


@dataclass
class Group:
    """Items of one length: their places, words, and by walk and table their sorted keys."""

    places: np.ndarray
    words: np.ndarray
    budget: int
    tables: list[list[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Items:
    """What a pass over the documents needs: items by length, and the pieces that point to windows."""

    ids: list[int | None] = field(default_factory=list)
    groups: dict[int, Group] = field(default_factory=dict)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    bloom: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], similarity: float, recall: float) -> Items:
        """Items without words are left out. ``seeds``, by length of a piece: sorted hashes with the item's length and the piece's offset."""
        words = [word_hashes(t) for _, t in rows]
        out = cls([i for i, _ in rows], bloom=np.zeros(1 << 22, dtype=bool))
        pieces: dict[int, set[tuple[int, int, int]]] = {}
        for n in sorted({len(w) for w in words} - {0}):
            places = np.array([k for k, w in enumerate(words) if len(w) == n])
            stack, budget, size = np.stack([words[k] for k in places]), int((1 - similarity) * n + 1e-9), np.full(len(places), n)
            cuts = [n * p // (budget + 1) for p in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found = np.unique(_hash_rows(stack[:, a:b]))
                pieces.setdefault(b - a, set()).update((h, n, a) for h in found.tolist())
            tables = []
            for walk in range(walks_for(stack, budget, recall)):
                keys = table_keys(embed(stack, size, walk), n, walk)
                orders = np.argsort(keys, axis=0)
                tables.append([(keys[orders[:, t], t], orders[:, t]) for t in range(TABLES)])
            out.groups[n] = Group(places, stack, budget, tables)
        for width, found in pieces.items():
            h, n, a = (np.array(c, t) for c, t in zip(zip(*sorted(found), strict=True), (np.uint64, np.int64, np.int64), strict=True))
            out.seeds[width] = (h, n, a)
            out.bloom[(h & np.uint64(len(out.bloom) - 1)).astype(np.int64)] = True
        return out


def _hash_rows(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for i in range(words.shape[1]):
        out = _mix(out + words[:, i])
    return out


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position."""
    count = len(words) - n + 1
    out = np.zeros(max(0, count), dtype=np.uint64)
    for i in range(n):
        out = _mix(out + words[i : i + count]) if count > 0 else out
    return out


def _ranges(lo: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``lo[0], lo[0] + 1, ...`` ``times[0]`` long, then the same from ``lo[1]``, and so on."""
    return np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _blocks(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose weights sum up to about ``most``."""
    at, total = 0, np.cumsum(weights)
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def windows_near_seeds(items: Items, words: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
    """By item length: sorted starts, in documents laid end to end, of windows that may match."""
    spots: dict[int, np.ndarray] = {}
    mask = np.uint64(len(items.bloom) - 1)
    for width, (hashes, size, offset) in items.seeds.items():
        h = gram_hash(words, width)
        at = np.flatnonzero(items.bloom[(h & mask).astype(np.int64)])
        lo, hi = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
        doc = np.searchsorted(begins, at, "right") - 1
        keep = (hi > lo) & (at + width <= begins[doc] + lengths[doc])
        at, lo, times, doc = at[keep], lo[keep], (hi - lo)[keep], doc[keep]
        for own in _blocks(times, SPOTS // 16):
            which = _ranges(lo[own], times[own])
            spot, d = np.repeat(at[own], times[own]), np.repeat(doc[own], times[own])
            for n in np.unique(size[which]).tolist():
                mine = size[which] == n
                e, first = items.groups[n].budget, begins[d[mine]]
                last = np.maximum(first, first + lengths[d[mine]] - n)
                starts = (spot[mine] - offset[which[mine]])[:, None] + np.arange(-e, e + 1)
                starts = np.unique(np.clip(starts, first[:, None], last[:, None]))
                spots[n] = np.union1d(spots[n], starts) if n in spots else starts
    return spots


def _candidates(group: Group, n: int, win: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, item)`` pairs of windows and items of the group that share a key in some table of some walk."""
    grid = np.zeros((len(win), len(group.places)), dtype=bool)
    for walk, tables in enumerate(group.tables):
        keys = table_keys(embed(win, sizes, walk), n, walk)
        for t, (known, order) in enumerate(tables):
            lo, hi = np.searchsorted(known, keys[:, t]), np.searchsorted(known, keys[:, t], "right")
            if (hi > lo).any():
                grid[np.repeat(np.arange(len(win)), hi - lo), order[_ranges(lo, hi - lo)]] = True
    return np.nonzero(grid)


def _verified(group: Group, n: int, win: np.ndarray, sizes: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs, few at a time."""
    out = np.zeros(len(row), dtype=np.int64)
    if n > 64:
        for at in range(0, len(row), step := max(1, GRID // n)):
            r, k = row[at : at + step], item[at : at + step]
            out[at : at + step] = edit_distances(group.words[k], win[r], sizes[r])
        return out
    order = np.argsort(item, kind="stable")
    for at in range(0, len(row), 16_384):
        own = order[at : at + 16_384]
        k, places = np.unique(item[own], return_inverse=True)
        for a in range(0, len(k), 64):  # so few items that their words' table stays small
            some = (places >= a) & (places < a + 64)
            out[own[some]] = bit_distances(group.words[k[a : a + 64]], places[some] - a, win, row[own[some]], sizes)
    return out


def leaks(items: Items, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """``(text, item, distance, start)``: the best window of each leaked item of each text; the first of equally good ones."""
    lengths = np.array([len(t) for t in texts])
    full = np.flatnonzero(lengths)
    none = (np.zeros(0, np.int64),) * 4
    if not len(full) or not items.groups:
        return none
    words, begins = np.concatenate(texts), (np.cumsum(lengths) - lengths)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _A)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(words) * power[:-1], dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(_TURN))]))
    found = [none]
    for n, starts in windows_near_seeds(items, words, begins[full], lengths[full]).items():
        group = items.groups[n]
        doc = full[np.searchsorted(begins[full], starts, "right") - 1]
        ends = np.minimum(starts + n, begins[doc] + lengths[doc])
        key = (total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        times, reps = np.diff(np.append(edge, len(order))), order[edge]
        for own in _blocks(np.ones(len(reps), np.int64), min(4096, max(1, GRID // len(group.places)))):
            first, size = starts[reps[own]], (ends - starts)[reps[own]]
            grid = first[:, None] + np.arange(n)
            win = np.where(np.arange(n) < size[:, None], words[np.minimum(grid, len(words) - 1)], np.uint64(0))
            row, k = _candidates(group, n, win, size)
            d = _verified(group, n, win, size, row, k)
            ok = d <= group.budget
            row, k, d = row[ok], k[ok], d[ok]
            for part in _blocks(times[own][row], SPREAD):  # every window with these words
                many = times[own][row[part]]
                at = order[_ranges(edge[own][row[part]], many)]
                found.append(_best(doc[at], group.places[np.repeat(k[part], many)], np.repeat(d[part], many), (starts - begins[doc])[at]))
            if sum(len(x[0]) for x in found) > SPREAD:
                found = [_best(*map(np.concatenate, zip(*found, strict=True)))]
    return _best(*map(np.concatenate, zip(*found, strict=True)))


def _best(text: np.ndarray, item: np.ndarray, distance: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((start, distance, item, text))
    t, k = text[order], item[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    at = order[new]
    return text[at], item[at], distance[at], start[at]


def _found_in(items: Items):
    """A function from a column of texts to ``leaks``, text by text as rows of the column, piece by piece."""
    widest = max(items.groups, default=1)

    def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for row, text in enumerate(column):
            words = word_hashes(text.as_py())
            for at in range(0, max(1, len(words) - widest + 1), CHUNK_WORDS):
                yield row, at, words[at : at + CHUNK_WORDS + widest - 1]

    def run(column: pa.Array) -> tuple[np.ndarray, ...]:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> None:
            t, k, d, s = leaks(items, [x[2] for x in held])
            rows, skips = (np.array([x[c] for x in held], dtype=np.int64) for c in (0, 1))
            found.append((rows[t], k, d, s + skips[t]))
            held.clear()

        size = 0
        for piece in pieces(column):
            held.append(piece)
            size += len(piece[2])
            if size > CHUNK_WORDS:
                flush()
                size = 0
        if held:
            flush()
        return _best(*map(np.concatenate, zip(*found, strict=True)))

    return run


def _search(items: Items):
    size_of = {int(k): n for n, g in items.groups.items() for k in g.places}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, types = _found_in(items), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        for batch in batches:
            row, k, d, s = search(batch.column(1))
            if len(row):
                n = np.array([size_of[x] for x in k.tolist()])
                cols = (batch.column(0).take(pa.array(row)), pa.array([items.ids[x] for x in k.tolist()], types[1]), pa.array(s), pa.array(d, types[3]), pa.array(1 - d / n))
                yield pa.RecordBatch.from_arrays(list(cols), [x.split()[0] for x in FOUND.split(", ")])

    return run


def _clean(items: Items, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _found_in(items)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[search(batch.column(column))[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of ``size`` items or ``BLOCK_WORDS`` words: the query set, held against all rows block by block."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    held, words = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        words += len(r[1] or "") // 4
        if len(held) == size or words > BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.999, block: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, start, distance, similarity)``: leaked items of each document, with the best window.

    Null and empty texts have no windows; null and empty items never match;
    items repeated whole count once, items that share an id are each reported;
    repeated documents are each reported; other columns are ignored; either
    table may be empty. Documents stay where they are read: nothing but the
    matches moves. The benchmark is sent out in blocks of ``block`` items; the
    driver holds one block at a time, and the matches of a block are written
    to the shared folder before the next one if there are several.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, last = None, None
    for rest in item_blocks(benchmark, block):
        if last is not None:
            part = cut_lineage(rows.mapInArrow(_search(Items.build(last, similarity, recall)), FOUND))
            out = part if out is None else out.unionByName(part)
        last = rest
    if last is None:
        return rows.sparkSession.createDataFrame([], FOUND)
    part = rows.mapInArrow(_search(Items.build(last, similarity, recall)), FOUND)
    return part if out is None else out.unionByName(part)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.999, block: int = BLOCK_ITEMS) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item leaks, judged by each row's own text.

    Ids play no part, so null and repeated ids are safe; null texts stay; all
    columns pass through. Rows go through the blocks of the benchmark one
    after another and are never shuffled.
    """
    for rows in item_blocks(benchmark, block):
        docs = docs.mapInArrow(_clean(Items.build(rows, similarity, recall), docs.columns.index("text")), docs.schema)
    return docs
