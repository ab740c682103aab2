import math
import random
import zlib

import numpy as np
import pytest

from corvane.llm.quality import DIM, REACH, SHAPES, TOKEN, Model, classify, fit, index_vector, keep_quality, shape, word_vectors


def corpus(n, seed=1):
    rnd = random.Random(seed)
    stems = ["the", "river", "stone", "light", "over", "green", "house", "and", "of", "walks"]
    out = []
    for i in range(n):
        words = [rnd.choice(stems) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            kind = i // 4 % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + " |" for w in words] if kind == 1 else [w for w in words[:8] for _ in range(9)]
        out.append((i, " ".join(words), 0 if bad else 1))
    return out


def test_held_out_accuracy_and_fold(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "label", 0.1) for i, t, _ in rows] + [(None, "a b", "x", 0.0), (9001, None, "x", 0.0), (9002, "", "x", 0.0), (3, rows[3][1], "x", 0.0)], "doc_id long, text string, quality string, score double").repartition(4)
    labels = spark.createDataFrame([(i, y, "text") for i, _, y in rows if i % 5] + [(None, 1, ""), (1, None, ""), (7, rows[7][2], "")], "doc_id long, quality int, text string")
    got = classify(docs, labels).collect()
    assert len(got) == 604
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = keep_quality(docs, labels).collect()
    assert {r.doc_id for r in kept if r.doc_id in truth} == {r.doc_id for r in got if r.predicted and r.doc_id in truth}


def test_scores_do_not_see_labels_of_the_held_out_fold(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a, b = (spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, quality int") for f in (lambda _, y: y, flip))
    score = lambda x: sorted((r.doc_id, r.score) for r in classify(docs, x).collect())
    assert score(a) == score(b)


def test_no_labels_no_documents_and_round_trip(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert keep_quality(docs, none).count() == 2
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert classify(docs, one).count() == 2 and classify(docs.limit(0), one).count() == 0
    rows = corpus(80)
    model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
    same = Model.load(model.dump())
    for text in (rows[0][1], "", None, "word " * 20000, "\u0000 <>"):
        assert abs(model.score(model.pool(text)[None])[0] - same.score(same.pool(text)[None])[0]) < 1e-9


def test_vectors_pooling_and_scores_match_plain_loops():
    rows = corpus(120)
    texts = [t for _, t, _ in rows]
    model = fit(texts, [y for _, _, y in rows])
    lists = [TOKEN.findall(t) for t in texts]
    words, vectors = word_vectors(lists)
    assert words == model.words and set(words) == {w for w in {t for x in lists for t in x} if sum(x.count(w) for x in lists) >= 20}
    name = lambda t: t if t in model.number else "\n" + shape(t)
    base = lambda t: index_vector(t) + (index_vector("\n" + shape(t)) if not t.startswith("\n") else 0)
    for w in [words[0], words[-1]]:
        near = np.zeros(DIM)
        for tokens in lists:
            for i, t in enumerate(tokens):
                if t == w:
                    for j in range(max(0, i - REACH), min(len(tokens), i + REACH + 1)):
                        near = near + (base(name(tokens[j])) if j != i else 0)
        assert vectors[words.index(w)] == pytest.approx(base(w) + near / np.linalg.norm(near), abs=1e-4)
    for text in (texts[0], texts[1], texts[4], "one unseen UNSEEN 12 !!", "a a a b"):
        tokens = TOKEN.findall(text)
        place = [model.number[t] if t in model.number else len(words) + SHAPES.index(shape(t)) for t in tokens]
        mean = [sum(float(model.vectors[p][d]) for p in place) / len(tokens) for d in range(DIM)]
        x = [*mean, math.sqrt(sum(v * v for v in mean)), len(set(tokens)) / len(tokens), sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)]
        w = model.weights
        hidden = [math.tanh(sum((x[i] - w["mean"][i]) / w["scale"][i] * w["w1"][i][k] for i in range(len(x))) + w["b1"][k]) for k in range(len(w["b1"]))]
        z = (sum(h * v for h, v in zip(hidden, w["w2"], strict=True)) + float(w["b2"][0])) / model.temperature
        assert model.score(model.pool(text)[None])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
