import hashlib
import random

from corvane.llm.minhash import edited_text, fingerprint_documents, fingerprint_edits, likeness_of, packed, shingle_hashes, signature


def jaccard(a, b):
    a, b = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rnd = random.Random(2)
    vocab = [f"é{i}" if i % 7 == 0 else f"w{i}" for i in range(300)]
    out = [" ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 3, 5, 8, 60, 400, 2500]))) for _ in range(60)]
    return [*out, "", None, " \n", out[0], "word " * 30000]


def test_next_edit_and_likeness(spark):
    rnd = random.Random(4)
    rows = [(i * 7 + rnd.randrange(7), t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, stretch string, guard int").repartition(5)
    for stretch in (4, 10_000):
        got = {r.doc_id: r for r in fingerprint_edits(docs, stretch).collect()}
        assert len(got) == len(rows)
        off = []
        for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
            t, nxt, r = t or "", nxt or "", got[i]
            edit = edited_text(t, nxt)
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            assert r.fingerprint == packed(signature(t)[0]) and r.edited_fingerprint == packed(signature(edit)[0])
            assert abs(r.near_edited - likeness_of(r.fingerprint, r.edited_fingerprint)) < 1e-12
            off.append(r.near_edited - jaccard(t, edit))
            off.append(r.near_next - jaccard(t, nxt))
        assert max(map(abs, off)) < 0.15
        assert sum(x * x for x in off) / len(off) < 0.03**2


def test_ties_nulls_repeats_and_single(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprint_edits(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    rows = [(None, "n u l l"), (1, "a b"), (1, "a b"), (1, "b c"), (2, None), (None, "n u l l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stretch in (1, 3):
        got = fingerprint_edits(docs, stretch).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    assert fingerprint_edits(docs.limit(0)).count() == 0


def test_estimate_is_unbiased_at_every_length():
    rnd = random.Random(9)
    for n in (6, 12, 30, 200, 1000):
        err = []
        for _ in range(60):
            a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            b = a[: n // 2] + [f"w{rnd.randrange(10**6)}" for _ in range(n - n // 2)]
            a, b = " ".join(a), " ".join(b)
            err.append(likeness_of(packed(signature(a)[0]), packed(signature(b)[0])) - jaccard(a, b))
        assert abs(sum(err) / len(err)) < 0.03


def test_fingerprint_documents(spark):
    rows = [(1, "A b c d e f"), (2, "a B c d e f"), (3, None)]
    got = {r.doc_id: r.fingerprint for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and set(got[3]) == {"0"}
