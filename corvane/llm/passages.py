"""Substring deduplication with automata over repeated phrases.

Hashes tell which segments of documents may hold a recurring window of words
(see ``windows``) and which shard has to look at them: the one of their anchor. There
the recurring windows are confirmed on the first occurrences of each class and
the repeats beside them, the confirmed passages are compiled into an Aho-Corasick
automaton over word numbers, and every occurrence streams through it.
Only what an automaton locates is removed. Parts of documents that hold no
anchor of a shard are not sent to it; its automaton cannot match them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.windows import BATCH_ANCHOR, Plan, _mix, by_text, merged, ranges_batch, without_repeats

#: Words of candidate text for one automaton; whole anchors, or whole salts of hot ones, only.
SHARD_WORDS = 30_000
#: Occurrences of one anchor in a shard; above, they are dealt over several, each with an automaton of all the anchor's passages.
HOT_PASSAGE = 500
#: Odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _rolling(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the ``size`` numbers from each position, by differences of prefix sums."""
    up = np.cumprod(np.full(len(x), base, dtype=np.uint64))
    down = np.cumprod(np.full(len(x), pow(base, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up)])
    return (sums[size:] - sums[:-size]) * down[: len(x) - size + 1]


def _classes(x: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` numbers from each place, equal where two 64-bit hashes of them are."""
    one, two = (_rolling(x, size, base)[where] for base in BASES)
    order = np.lexsort((two, one))
    out = np.zeros(len(where), dtype=np.int64)
    out[order[1:]] = np.cumsum((one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
    return out


def confirmed(texts: list[tuple[int, ...]], docs: list[int], size: int) -> dict[tuple[int, ...], int]:
    """Passages, numbered, of all windows of ``size`` words that occur in two documents or more.

    Windows that follow each other wherever one of them stands form one passage,
    so every occurrence of a window lies in one of its passage.
    """
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    windows = np.maximum(lengths - size + 1, 0)
    if not windows.any():
        return {}
    x = np.fromiter(chain.from_iterable(texts), np.uint64, int(lengths.sum()))
    x = _mix(x + np.uint64(1))
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = at + (np.cumsum(lengths) - lengths)[text]
    cls = _classes(x, where, size)
    times, doc = np.bincount(cls), np.array(docs, dtype=np.int64)[text]
    least, most = np.full(len(times), np.iinfo(np.int64).max), np.full(len(times), np.iinfo(np.int64).min)
    np.minimum.at(least, cls, doc)
    np.maximum.at(most, cls, doc)
    shared = (least != most)[cls]
    link = np.zeros(len(cls), dtype=bool)  # this window and the next one always stand together
    ahead = np.flatnonzero(shared[:-1] & (text[1:] == text[:-1]))
    if len(ahead):
        pair = _classes(x, where[ahead], size + 1)
        both = np.bincount(pair)[pair]
        link[ahead] = (both == times[cls[ahead]]) & (both == times[cls[ahead + 1]])
    begin = shared.copy()
    begin[1:] &= ~link[:-1]
    begin = np.flatnonzero(begin)
    begin = begin[np.unique(cls[begin], return_index=True)[1]]
    last = np.flatnonzero(~link)
    last = last[np.searchsorted(last, begin)]
    found = zip(text[begin].tolist(), at[begin].tolist(), at[last].tolist(), strict=True)
    return {texts[k][i : j + size]: n for n, (k, i, j) in enumerate(found)}


def automaton(passages: dict[tuple[int, ...], int]) -> ahocorasick.Automaton:
    """Finds the numbers of passages in sequences of word numbers."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p, number in passages.items():
        out.add_word(p, number)
    out.make_automaton()
    return out


def occurrences(segs: list[bytes], docs: list[int], texts: list[int], starts: list[int], size: int) -> tuple[np.ndarray, ...]:
    """``(text, s, e)`` of the windows in ``segs`` that also start in a smaller document of them."""
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    numbered = [tuple(map(numbers.__getitem__, seg.split())) for seg in segs]
    passages = confirmed(numbered, docs, size)
    if not passages:
        return (np.zeros(0, np.int64),) * 3
    search = automaton(passages)
    hits = [list(search.iter(words)) for words in numbered]
    k = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
    end, p = np.fromiter(chain.from_iterable(chain.from_iterable(hits)), np.int64, 2 * len(k)).reshape(-1, 2).T
    doc = np.array(docs, dtype=np.int64)[k]
    least = np.full(len(passages), np.iinfo(np.int64).max)
    np.minimum.at(least, p, doc)
    gone = doc > least[p]
    k, e = k[gone], np.array(starts, dtype=np.int64)[k[gone]] + end[gone] + 1
    s = e - np.array([len(x) for x in passages])[p[gone]]
    text, _, s, e = merged(np.array(texts, dtype=np.int64)[k], np.zeros(len(k), np.int64), s, e)
    return text, s, e


def _compare(size: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, at = 0, None

        def flush() -> pa.RecordBatch:
            doc, own, s, seg = zip(*held, strict=True)
            texts, number = by_text(doc, own)
            return ranges_batch(texts, *occurrences(list(seg), list(doc), number.tolist(), list(s), size))

        for batch in batches:
            for ah, salt, doc, own, s, seg in zip(*(batch.column(n).to_pylist() for n in ("ah", "salt", "doc", "own", "s", "seg")), strict=True):
                if total >= shard_words and (ah, salt) != at:
                    yield flush()
                    held, total = [], 0
                at = ah, salt
                held.append((doc, own, s, seg))
                total += seg.count(b" ") + 1
        if held:
            yield flush()

    return run


def remove_repeated_passages(docs: DataFrame, size: int = 50, gram: int = 8, hot_anchor: int = HOT_PASSAGE, batch_anchor: int = BATCH_ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, n_tokens, spans, kept)`` for ``docs(doc_id, text)`` as words ``[^\\x20\\x09-\\x0D]+``.

    Every word covered by a window of ``size`` words whose sequence also starts
    in a document with a smaller doc_id is removed; windows are judged on the
    input; ``kept`` is the other words joined by a space. Null texts have no
    words, null ids come before all others, other columns are ignored, an empty
    table gives an empty result. Rows repeated whole count as one document and
    all get its result; rows that share an id but not a text each lose
    only what of themselves also starts in a smaller id.
    """
    return without_repeats(docs, Plan(size, gram, True, True, locate=True), _compare(size, shard_words), hot_anchor, batch_anchor)
