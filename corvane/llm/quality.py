"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Every token has a sparse ternary index vector drawn from its hash. A word's
vector is the sum of the index vectors of its neighbours in the fitting
documents (random indexing), scaled to one, plus its own index vector; words
that the fit has seen fewer than ``SEEN`` times take the vector of their shape
(case, digits, length). A document is the mean of its tokens' vectors, over its whole text.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")
DIM, NONZERO, REACH = 96, 6, 2
#: Labelled rows of the fit (their whole texts), and occurrences among them that make a word's neighbours tell something.
FIT_ROWS, SEEN = 6000, 20
#: Pairs of neighbours that the fit holds before it counts them.
FOLD = 1 << 19
SHAPES = [f"{c}{n}" for c in ("lower", "upper", "title", "mixed", "digit", "other") for n in (1, 3, 6, 12, 99)]
_SHAPE_NUMBER = {s: i for i, s in enumerate(SHAPES)}


def shape(token: str) -> str:
    """Case or kind of a token, and its length class."""
    kind = (
        "other" if not (token[0].isalnum() or token[0] == "_") else "digit" if any(c.isdigit() for c in token)
        else "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
    )
    n = len(token)
    return f"{kind}{1 if n <= 1 else 3 if n <= 3 else 6 if n <= 6 else 12 if n <= 12 else 99}"


def index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name.encode(), 3))
    v = np.zeros(DIM, dtype=np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO) / np.sqrt(NONZERO)
    return v


class Model:
    """Word vectors, network weights and temperature; ``score`` takes whole texts."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: dict[str, np.ndarray], temperature: float):
        self.number = {w: i for i, w in enumerate(words)}
        self.words, self.vectors, self.weights, self.temperature = words, vectors, weights, temperature

    def token_number(self, token: str) -> int:
        k = self.number.get(token)
        return len(self.words) + _SHAPE_NUMBER[shape(token)] if k is None else k

    def pool(self, text: str | None) -> np.ndarray:
        """Mean token vector, its length, and the shares of different and of just repeated tokens; zeros without tokens."""
        out = np.zeros(DIM + 3, dtype=np.float32)
        tokens = TOKEN.findall(text or "")
        counts = Counter(tokens)
        if not counts:
            return out
        total = sum(counts.values())
        known, rest = self.number.get, Counter()
        ids, times = [], []
        for token, n in counts.items():
            k = known(token)
            if k is None:
                rest[shape(token)] += n
            else:
                ids.append(k)
                times.append(n)
        for s, n in rest.items():
            ids.append(len(self.words) + _SHAPE_NUMBER[s])
            times.append(n)
        mean = np.asarray(times, dtype=np.float32) @ self.vectors[ids] / total
        out[:DIM], out[DIM], out[DIM + 1] = mean, np.linalg.norm(mean), len(counts) / total
        out[DIM + 2] = sum(map(eq, tokens, tokens[1:])) / total
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w = self.weights
        hidden = np.tanh(((pooled - w["mean"]) / w["scale"]) @ w["w1"] + w["b1"])
        return hidden @ w["w2"] + w["b2"]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(pooled).astype(np.float64) / self.temperature, -40, 40)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, words=np.array("\n".join(self.words)), vectors=self.vectors.astype(np.float16), temperature=self.temperature, **self.weights)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        words = str(z["words"]).split("\n") if z["words"] else []
        weights = {k: z[k] for k in ("mean", "scale", "w1", "b1", "w2", "b2")}
        return cls(words, z["vectors"].astype(np.float32), weights, float(z["temperature"]))


def _counted(names: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different names, ascending, and the sum of each one's times."""
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(names), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)


def word_vectors(token_lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Random indexing over the fitting documents: the words, and a row for each of them and each shape."""
    counts = Counter(t for tokens in token_lists for t in tokens)
    words = sorted(w for w, n in counts.items() if n >= SEEN)
    number = {w: i for i, w in enumerate(words)}
    own = np.stack([*(index_vector(w) for w in words), *(index_vector(f"\n{s}") for s in SHAPES)])
    own[: len(words)] += np.array([own[len(words) + _SHAPE_NUMBER[shape(w)]] for w in words], dtype=np.float32).reshape(-1, DIM)
    context, n, held = np.zeros_like(own), len(own), 0
    pairs: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    for tokens in token_lists:
        ids = np.array([number[t] if t in number else len(words) + _SHAPE_NUMBER[shape(t)] for t in tokens], dtype=np.int64)
        for d in range(1, REACH + 1):
            pairs += [ids[d:] * n + ids[:-d], ids[:-d] * n + ids[d:]] if len(ids) > d else []
        sums += [np.ones(len(p), np.int8) for p in pairs[len(sums) :]]
        held += 2 * REACH * len(ids)
        if held > FOLD:
            pair, times = _counted(pairs, sums)
            pairs, sums, held = [pair], [times], 0
    pair, times = _counted(pairs, sums)
    for at in range(0, len(pair), 50_000):
        i, j = np.divmod(pair[at : at + 50_000], n)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        context[i[first]] += np.add.reduceat(own[j] * times[at : at + 50_000, None].astype(np.float32), first)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return words, own + context / np.maximum(norm, 1e-6)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Two-layer network on all rows at once with Adam and weight decay; deterministic."""
    rng = np.random.default_rng(5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        z = h @ p[2] + p[3]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3]}


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Fits vectors and network on four fifths of the rows and the temperature on the rest."""
    same: dict[str, str] = {}
    lists = [[same.setdefault(t, t) for t in TOKEN.findall(text or "")] for text in texts]
    words, vectors = word_vectors(lists)
    vectors = vectors.astype(np.float16).astype(np.float32)
    model = Model(words, vectors, {}, 1.0)
    x = np.stack([model.pool(t) for t in texts]).astype(np.float64)
    y = np.array(labels, dtype=np.float64)
    held = np.arange(len(y)) % 5 == 4
    model.weights = train(x[~held], y[~held]) if (~held).any() else train(x, y)
    if held.any() and len(set(y[held])) > 1:
        z = model.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[held] > 0.5, -z, z) / t))
        model.temperature = float(min(np.geomspace(0.3, 8, 60), key=loss))
    return model


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, y)``: at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")  # at most ``rows`` rows of two numbers


def held_out(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model, fitted in one task on the bounded sample; ``None`` without labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([fit(texts, ys).dump()], pa.binary())], ["model"])

    one = fit_rows(docs, labels, rows).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "y")
    found = one.mapInArrow(run, "model binary").first()
    return Model.load(bytes(found["model"])) if found else None


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``, from the whole text alone; 0.5 throughout without a model."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(sent.value)
        for batch in batches:
            if batch.num_rows:
                pooled = np.stack([own.pool(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(pooled), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    Labels come from rows of ``labels(doc_id, quality)`` outside the held-out
    fold; null labels and ids are not learnt from, repeated labels of a
    document count by majority. Null and empty texts are scored like any
    other; a null id is not held out; repeated rows are all scored; other
    columns are ignored; without labels every score is 0.5; no documents give
    an empty result.
    """
    scored = score_documents(docs, fit_model(docs, labels, rows))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``least``; each row is judged on its own text."""
    model = fit_model(docs, labels, rows)
    if model is None:
        return docs
    names = [f for f in docs.columns if f in ("doc_id", "text")]
    sent = docs.sparkSession.sparkContext.broadcast(model.dump())
    at = docs.columns.index(names[-1]) if "text" in names else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(sent.value)
        for batch in batches:
            if batch.num_rows:
                pooled = np.stack([own.pool(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(own.score(pooled) >= least))

    return docs.mapInArrow(run, docs.schema)
