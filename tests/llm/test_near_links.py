import random

import numpy as np

from corvane.llm import simhash
from corvane.llm.minhash import shingle_hashes
from corvane.llm.simhash import differing, marked, near_groups, parity_bits


def words(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnopqrst", k=7)) for _ in range(n)]


def components(texts):
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r.group_id for r in near_groups(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_chains_of_changed_copies(spark):
    rnd, texts = random.Random(11), []
    for _ in range(5):
        w = words(rnd, 300)
        for _ in range(60):
            texts.append(" ".join(w))
            w = list(w)
            for i in rnd.sample(range(300), 5):
                w[i] = words(rnd, 1)[0]
    assert found(spark, texts) == components(texts)


def test_short_texts(spark):
    rnd, texts = random.Random(12), []
    for n in (8, 9, 10, 16) * 10:
        w = words(rnd, n)
        texts += [" ".join(w), " ".join(w + words(rnd, 1) if n < 16 else words(rnd, 1) + w[1:])]
    want = components(texts)
    assert len(set(want)) == 40 and found(spark, texts) == want


def test_long_texts_with_scattered_changes(spark):
    rnd, texts = random.Random(13), []
    for _ in range(100):
        w = words(rnd, 400)
        texts.append(" ".join(w))
        for i in rnd.sample(range(400), 8):
            w[i] = words(rnd, 1)[0]
        texts.append(" ".join(w))
    want = [i - i % 2 for i in range(200)]
    assert found(spark, texts) == want


def test_links_at_the_threshold(spark):
    rnd, texts, want = random.Random(14), [], []
    for cut in (20, 21, 22) * 20:
        w = words(rnd, 104)
        texts += [" ".join(w), " ".join(w[:-cut])]
        want += [len(want), len(want) + (cut > 20)]
    assert found(spark, texts) == want


def test_parity_bits_never_overstate_a_difference():
    rng = np.random.default_rng(3)
    for m, n, both in ((1, 1, 0), (5, 70, 3), (60, 66, 60), (900, 5000, 400), (0, 9, 0), (0, 0, 0)):
        x = rng.integers(0, 2**63, m + n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = x[:m], x[m - both :]
        assert differing(parity_bits(a), parity_bits(b)) <= m + n - 2 * both
    a, b = (rng.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(2))
    assert differing(parity_bits(a), parity_bits(b)) > 4000 / 9


def test_marked_bits(spark):
    keys = [-(2**63), -1, 0, 5, 2**40 + 7, 2**63 - 1]
    bits = np.unpackbits(np.frombuffer(marked(spark.createDataFrame([(k,) for k in keys], "same long"), 1 << 18), np.uint8))
    assert sorted(np.flatnonzero(bits).tolist()) == sorted({k % (1 << 18) for k in keys})


def test_settled_buckets_are_not_read_again(spark, monkeypatch):
    rnd, texts = random.Random(15), []
    for _ in range(30):
        w = words(rnd, 60)
        texts += [" ".join(w), " ".join(w[:-1])]
    shared = words(rnd, 20)
    texts += [" ".join(shared + words(rnd, 8)) for _ in range(30)]
    across, read = simhash._across, []

    def counted(rows, *args):
        read.append(rows.count())
        return across(rows, *args)

    monkeypatch.setattr(simhash, "_across", counted)
    monkeypatch.setattr(simhash, "PAIRS", 0)
    monkeypatch.setattr(simhash, "FASTER", 2)
    assert found(spark, texts) == components(texts)
    assert len(read) > 2 and max(read[1:]) < read[0]


def test_buckets_whose_documents_all_had_their_turn_are_not_read_again(spark, monkeypatch):
    rnd, texts = random.Random(16), []
    for _ in range(20):
        shared = words(rnd, 6)
        texts += [" ".join(words(rnd, 3) + shared + words(rnd, 3)) for _ in range(3)]
    shared = words(rnd, 8)
    texts += [" ".join(shared + words(rnd, 8)) for _ in range(40)]
    w = words(rnd, 8)
    texts += [" ".join(shared + w), " ".join(shared + w + words(rnd, 1))]
    across, read = simhash._across, []

    def counted(rows, *args):
        read.append({p: c for p, c in rows.groupBy("p").count().collect()})
        return across(rows, *args)

    monkeypatch.setattr(simhash, "_across", counted)
    monkeypatch.setattr(simhash, "PAIRS", 0)
    monkeypatch.setattr(simhash, "FASTER", 4)
    want = components(texts)
    assert len(set(want)) == len(texts) - 1 and found(spark, texts) == want
    assert len(read) > 2 and min(read[0].values()) < 4 and max(read[0].values()) > 16
    assert all(min(r.values(), default=99) >= 4 ** (i + 1) for i, r in enumerate(read[1:]))


def test_the_hub_of_a_bucket_stays_the_hub(spark, tmp_path):
    rows = [(9, i, 10, False) for i in range(1, 8)] + [(8, 1, 10, False), (8, 2, 10, False)]
    shared = spark.createDataFrame(rows, "p long, same long, n long, hub boolean")
    links = [(1, 2), (1, 3), (4, 5), (6, 7)]
    once = simhash._across(shared, spark.createDataFrame(links, "a long, b long"), f"{tmp_path}")
    assert {(r.p, r.most) for r in once.collect()} == {(9, 1)}
    again = simhash._across(once.select(shared.columns), spark.createDataFrame([*links, (4, 6)], "a long, b long"), f"{tmp_path}")
    assert {(r.same, r.root, r.most, r.hub) for r in again.collect()} == {(i, 1 if i < 4 else 4, 1, i < 4) for i in range(1, 8)}
