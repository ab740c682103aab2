import random
import tracemalloc

import numpy as np
import pyarrow as pa

from corvane.llm import decontaminate
from corvane.llm.decontaminate import WORD, Items, bit_distances, edit_distances, find_leaks, leaks, walks_for, without_leaks, word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(docs, items, similarity=0.8):
    """Every window of every document against every item, by the table that ``test_edit_distances_match_plain_dp`` proves."""
    out = {}
    for d, t in docs:
        w = word_hashes(t)
        for k, text in items:
            p = word_hashes(text)
            if not len(p) or not len(w):
                continue
            n = min(len(p), len(w))
            windows = np.stack([w[s : s + n] for s in range(len(w) - n + 1)])
            far = edit_distances(np.broadcast_to(p, (len(windows), len(p))), windows, np.full(len(windows), n))
            if far.min() <= int((1 - similarity) * len(p) + 1e-9):
                out[d, k] = int(far.min()), int(far.argmin())
    return out


def noisy(rnd, words, vocab, edits):
    out = list(words)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        kind = rnd.random()
        if kind < 0.5:
            out[k] = rnd.choice(vocab)
        elif kind < 0.75 and len(out) > 1:
            out.pop(k)
        else:
            out.insert(k, rnd.choice(vocab))
    return out


def test_recall_and_exact_verification(spark):
    rnd = random.Random(1)
    vocab = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(15, 50)))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "two words"), (103, "five short words of text"), (104, items[0][1]), (105, "v7")]
    docs = []
    for i in range(150):
        words = rnd.choices(vocab, k=rnd.randint(0, 150))
        if i % 2:
            p = rnd.choice(items[:30])[1].split()
            at = rnd.randint(0, len(words))
            words[at:at] = noisy(rnd, p, vocab, rnd.randint(0, len(p) // 4))
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    docs += [(500, None), (501, "  "), (505, "Two words"), (502, "five SHORT words: of text."), (503, " ".join(items[3][1].split()[:-1])), (None, items[4][1])]
    want = brute(docs, items)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, distance string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2000, 7):
        got = {(r.doc_id, r.item_id): (r.distance, r.start) for r in find_leaks(table, bench, block=block).collect()}
        assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
        assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    clean = {r.doc_id for r in without_leaks(table, bench).collect()}
    found = {d for d, _ in got}
    assert clean == {i for i, _ in docs} - found and None in found


def test_edit_distances_match_plain_dp():
    rng = np.random.default_rng(3)
    items, windows = rng.integers(0, 6, (200, 12)).astype(np.uint64), rng.integers(0, 6, (200, 14)).astype(np.uint64)
    lengths = rng.integers(0, 15, 200)
    got = edit_distances(items, windows, lengths)
    assert got.tolist() == [distance(a.tolist(), b[:n].tolist()) for a, b, n in zip(items, windows, lengths, strict=True)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, none).count() == 0
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_calibration_reaches_recall():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 500, (20, 40)).astype(np.uint64)
    few, more = walks_for(items, 8, 0.9), walks_for(items, 8, 0.9999)
    assert 1 <= few <= more
    assert walks_for(items[:, :3], 0, 0.9999) == 1


def test_bit_distances_match_plain_dp():
    rng = np.random.default_rng(4)
    for n in (1, 7, 63, 64):
        items, windows = rng.integers(0, 9, (6, n)).astype(np.uint64), rng.integers(0, 12, (30, n)).astype(np.uint64)
        lengths = np.where(rng.random(30) < 0.3, rng.integers(1, n + 1, 30), n)
        item, row = rng.integers(0, 6, 200), rng.integers(0, 30, 200)
        got = bit_distances(items, item, windows, row, lengths)
        assert got.tolist() == [distance(items[a].tolist(), windows[b][: lengths[b]].tolist()) for a, b in zip(item, row, strict=True)]


def test_words_of_long_texts(monkeypatch):
    text = "Ab\u0130 c_d, \u03a3\u03a3.x " * 200
    whole = word_hashes(text)
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    assert (word_hashes(text) == whole).all() and len(whole) == len(WORD.findall(text.lower()))


def test_long_documents_are_searched_in_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(rnd.choices(vocab, k=n))) for k, n in enumerate([12, 30, 30, 70, 90])]
    docs = []
    for i in range(30):
        words = rnd.choices(vocab, k=rnd.randint(0, 600))
        for _, t in rnd.sample(items, 2):
            at = rnd.randint(0, len(words))
            words[at:at] = noisy(rnd, t.split(), vocab, rnd.randint(0, 2))
        docs.append((i, " ".join(words)))
    prepared = Items.build(items, 0.8, 0.999)
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 100)
    monkeypatch.setattr(decontaminate, "SPOTS", 64)
    monkeypatch.setattr(decontaminate, "GRID", 40)
    monkeypatch.setattr(decontaminate, "SPREAD", 5)
    row, k, d, s = decontaminate._found_in(prepared)(pa.array([t for _, t in docs]))
    assert {(docs[a][0], b): (c, e) for a, b, c, e in zip(row, k, d, s, strict=True)} == brute(docs, items)


def test_near_copy_items_in_a_hot_passage_take_little_memory():
    rnd = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    passage = rnd.choices(vocab, k=40)
    items = []
    for k in range(200):
        words = list(passage)
        words[rnd.randrange(40)] = f"own{k}"
        items.append((k, " ".join(words)))
    texts = [word_hashes(" ".join(rnd.choices(vocab, k=30) + passage + rnd.choices(vocab, k=30))) for _ in range(1200)]
    prepared = Items.build(items, 0.8, 0.999)
    tracemalloc.start()
    row, k, d, s = leaks(prepared, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 1200 * 200 and (d == 1).all() and (s == 30).all()
    assert peak < 300e6


def test_rows_with_one_id_are_judged_by_their_own_text(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, leak), (1, "clean"), (None, leak), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, leak), (8, "other words here")], "item_id long, text string")
    for block in (2000, 1):
        got = without_leaks(docs, bench, block=block).collect()
        assert sorted(map(str, got)) == sorted(map(str, [r for r in docs.collect() if r.text != leak]))
