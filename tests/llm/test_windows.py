import random

import numpy as np
import pytest

from corvane.llm import passages, windows
from corvane.llm.passages import remove_repeated_passages
from corvane.llm.suffix import interleave, remove_repeated_bytes, repeated_intervals, repeats, suffix_order, transform
from corvane.llm.windows import Plan, segments, sliding_min


def corpus(seed, alphabet, n=40, most=160):
    rnd = random.Random(seed)
    stock = ["".join(rnd.choices(alphabet, k=rnd.randint(10, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(stock) if rnd.random() < 0.5 else "".join(rnd.choices(alphabet, k=rnd.randint(0, most))))
        out.append("".join(parts))
    return [*out, "", None, out[3], out[3], "ab" * 400, "é" * 150, "a" * 500, "x y " * 300, "ba" * 300]


def brute(rows, size, words, strict):
    docs = {i: (t or "").encode().split() if words else (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(docs, key=lambda x: (x is not None, x or 0)):
        for s in range(len(docs[i]) - size + 1):
            first.setdefault(tuple(docs[i][s : s + size]), (i, s))
    out = {}
    for i, items in docs.items():
        gone = [False] * len(items)
        for s in range(len(items) - size + 1):
            at = first[tuple(items[s : s + size])]
            if (at[0] != i) if strict else (at != (i, s)):
                gone[s : s + size] = [True] * size
        kept = [x for x, g in zip(items, gone, strict=True) if not g]
        out[i] = (len(items), sum(gone), b" ".join(kept) if words else bytes(kept))
    return out


def check(rows, got, size, words, strict):
    want = brute(rows, size, words, strict)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, sum(x.e - x.s for x in r.spans), bytes(r.kept)) == want[r.doc_id], r.doc_id
        for a, b in zip(r.spans, r.spans[1:], strict=False):
            assert a.e < b.s


@pytest.mark.parametrize(("seed", "alphabet", "hot"), [(1, "abc defgh\n", 4000), (2, "ab", 4000), (3, "abcdefghij klm", 2), (4, "aé\u0000 ", 1)])
def test_bytes_match_brute_force(spark, seed, alphabet, hot):
    texts = corpus(seed, alphabet)
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    rows[5] = (None, rows[5][1])
    docs = spark.createDataFrame([(i, t, "x", 0, "k") for i, t in [*rows, rows[0]]], "doc_id long, text string, s string, e int, kept string").repartition(3)
    for batch in (32, 1):
        got = remove_repeated_bytes(docs, size=40, gram=8, hot_anchor=hot, batch_anchor=batch, shard_bytes=700).collect()
        check([*rows, rows[0]], got, 40, False, False)


@pytest.mark.parametrize(("seed", "hot"), [(1, 4000), (2, 1), (5, 3)])
def test_words_match_brute_force(spark, seed, hot):
    rnd = random.Random(seed)
    texts = [None if t is None else " ".join(t) if rnd.random() < 0.9 else "\n".join(t) for t in corpus(seed, "abcdefg", most=60)]
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts, strict=True))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, doc string").repartition(3)
    for batch in (32, 1, 3):
        got = remove_repeated_passages(docs, size=12, gram=4, hot_anchor=hot, batch_anchor=batch, shard_words=60).collect()
        check(rows, got, 12, True, True)


def test_production_sizes(spark):
    rnd = random.Random(8)
    words = [f"{rnd.choice(['the', 'of', 'über'])}{rnd.randrange(40)}" for _ in range(400)]
    passage = " ".join(rnd.choices(words, k=70))
    rows = []
    for i in range(60):
        own = " ".join(rnd.choices(words, k=rnd.randint(0, 300)))
        rows.append((i, f"{own} {passage} {own[::-1]}" if i % 3 == 0 else own))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, remove_repeated_bytes(docs).collect(), 100, False, False)
    check(rows, remove_repeated_passages(docs).collect(), 50, True, True)


def test_without_automata_no_passage_goes(spark, monkeypatch):
    rnd = random.Random(12)
    stock = [" ".join(rnd.choices("abcdefgh", k=30)) for _ in range(3)]
    rows = [(i, " ".join([*rnd.choices("abcdefgh", k=rnd.randint(0, 20)), stock[i % 3]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, batch in ((500, 32), (2, 32), (2, 1)):
        args = {"size": 12, "gram": 4, "hot_anchor": hot, "batch_anchor": batch}
        check(rows, remove_repeated_passages(docs, **args).collect(), 12, True, True)
        with monkeypatch.context() as patch:
            patch.setattr(passages, "_compare", lambda *_: lambda batches: (b.select(["doc", "own", "s", "s"]).slice(0, 0).rename_columns(["doc", "own", "s", "e"]) for b in batches))
            left = remove_repeated_passages(docs, **args).collect()
        assert all(r.spans == [] and bytes(r.kept).decode() == dict(rows)[r.doc_id] for r in left)


def test_passages_cover_the_windows_of_two_documents_or_more():
    rnd = random.Random(14)
    for _ in range(200):
        size = rnd.randint(1, 6)
        texts = [tuple(rnd.choices(range(3), k=rnd.randint(0, 14))) for _ in range(rnd.randint(1, 8))]
        texts += rnd.choices(texts, k=rnd.randint(0, 2))
        docs = [rnd.randint(-3, 4) for _ in texts]
        where = {}
        for d, w in zip(docs, texts, strict=True):
            for i in range(len(w) - size + 1):
                where.setdefault(w[i : i + size], set()).add(d)
        held = passages.confirmed(texts, docs, size)
        assert {p[i : i + size] for p in held for i in range(len(p) - size + 1)} == {w for w, d in where.items() if len(d) > 1}
        text, s, e = passages.occurrences([" ".join(map(str, w)).encode() for w in texts], docs, list(range(len(texts))), [0] * len(texts), size)
        got = {(k, x) for k, a, b in zip(text, s, e, strict=True) for x in range(a, b)}
        assert got == {(k, x) for k, w in enumerate(texts) for i in range(len(w) - size + 1) if min(where[w[i : i + size]]) < docs[k] for x in range(i, i + size)}


def test_a_passage_in_very_many_copies_is_dealt_over_salts(spark):
    rnd = random.Random(13)
    copy = " ".join(rnd.choices("abcdefgh", k=30))
    rows = [(i, copy if i % 4 else f"{i} {copy} {-i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (100, 20):
        check(rows, remove_repeated_passages(docs, size=12, gram=4, hot_anchor=hot).collect(), 12, True, True)


def test_copies_of_a_hot_segment_are_not_split_into_windows(spark, monkeypatch):
    rnd = random.Random(16)
    copy = rnd.choices("abcdefgh", k=30)
    unlike = [" ".join([*copy[:k], *rnd.choices("abcdefgh", k=4), *copy[k:]]) for k in (14, 15, 16, 17)]
    rows = [(i, unlike[i % 4] if i % 50 else " ".join(rnd.choices("abcdefgh", k=30))) for i in range(400)]
    dealt, sizes = windows._dealt, []

    def counted(df):
        sizes.append(df.count())
        return dealt(df)

    monkeypatch.setattr(windows, "_dealt", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, remove_repeated_passages(docs, size=12, gram=4, hot_anchor=2).collect(), 12, True, True)
    assert len(sizes) == 2 and sizes[1] < 500


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(docs).count() == 0
    assert remove_repeated_passages(docs).count() == 0


def test_interleave_merges_transforms_without_sorting():
    rnd = random.Random(3)
    segs = ["".join(rnd.choices("ab", k=rnd.randint(0, 40))).encode() for _ in range(30)]
    shards = [segs[:7], segs[7:8], segs[8:22], segs[22:]]
    bwts, suffixes = [], []
    for part in shards:
        text, order, segment, offset = suffix_order(part)
        bwts.append(transform(text, order, offset))
        suffixes += [part[segment[p]][offset[p] :] for p in order]
    at, prefix = interleave(bwts, [len(p) for p in shards], 50)
    merged = [suffixes[k] for k in at]
    assert merged == sorted(suffixes)
    for k in range(1, len(merged)):
        a, b = merged[k - 1], merged[k]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix[k] == common


def test_repeated_intervals_are_those_of_the_whole_merge():
    rnd = random.Random(7)
    segs = ["".join(rnd.choices("abc", k=rnd.randint(0, 60))).encode() for _ in range(40)]
    segs += [segs[3] + b"x" + segs[9], segs[3]]
    shards = [segs[:11], segs[11:12], segs[12:]]
    bwts = [transform(t, o, f) for t, o, _, f in map(suffix_order, shards)]
    for depth in (1, 3, 9, 20):
        at, prefix = interleave(bwts, [len(p) for p in shards], depth)
        whole, own = {}, {}
        for k, i in zip(np.cumsum(prefix < depth), at, strict=True):
            whole.setdefault(k, set()).add(int(i))
        for k, i in zip(*reversed(repeated_intervals(bwts, depth)), strict=True):
            own.setdefault(k, set()).add(int(i))
        assert {frozenset(x) for x in own.values()} == {frozenset(x) for x in whole.values() if len(x) > 1}


def test_segments_own_every_window_once_and_agree_on_equal_windows():
    rnd = random.Random(1)
    plan = Plan(20, 8, False, False)
    block = bytes(rnd.choices(b"ab", k=60))
    texts = [bytes(rnd.choices(b"abc", k=n)) + block + bytes(rnd.choices(b"abc", k=9)) for n in (0, 3, 50)] + [b"ab" * 50, b"short", b"a" * 19]
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, s, e, ah, _ = segments(data, np.array([len(t) for t in texts]), plan)
    owner = {}
    seen = set()
    for t, a, b, h in zip(text, s, e, ah, strict=True):
        for p in range(a, b - plan.size + 1):
            assert (t, p) not in seen
            seen.add((t, p))
            assert owner.setdefault(texts[t][p : p + plan.size], h) == h
    assert len(seen) == sum(max(0, len(t) - plan.size + 1) for t in texts)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 50, 501).astype(np.uint64)
    for w in (1, 7, 64, 501):
        assert (sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_repeats_of_one_shard():
    doc, s, e = repeats([b"abcdefgh", b"xabcdefy", b"abcdefgh"], np.array([5, 2, 9]), np.array([0, 10, 0]), 6)
    assert list(zip(doc, s, e, strict=True)) == [(5, 0, 6), (9, 0, 8)]


def test_rows_with_one_id_keep_what_they_do_not_repeat(spark):
    rnd = random.Random(9)
    text = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(90))
    p, q, r = text(), text(), text()
    rows = [(0, p), (1, p), (1, q), (None, r), (None, q + " " + r), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(str(x.doc_id), bytes(x.kept).decode()) for x in remove_repeated_passages(docs).collect()]
    assert sorted(left) == sorted([("0", p), ("1", ""), ("1", ""), ("None", r), ("None", q + " " + r), ("None", "")])
    byte = [(str(x.doc_id), bytes(x.kept).decode()) for x in remove_repeated_bytes(docs).collect()]
    nulls = sorted(t for i, t in byte if i == "None")
    assert sorted(x for x in byte if x[0] != "None") == [("0", p), ("1", ""), ("1", "")]
    assert nulls in (sorted(["", "", q + " " + r]), sorted(["", r, q + " "]))
