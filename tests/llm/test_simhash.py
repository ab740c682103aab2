import random

import pytest
import xxhash

from corvane.llm.simhash import keep_one, near_components, simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, budget=2):
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= budget:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    ids = {c: min((fps[k][0] for k in range(len(fps)) if comp[k] == c and fps[k][0] is not None), default=None) for c in comp}
    return sorted(((i, f"{f:016x}", ids[c]) for (i, f), c in zip(fps, comp, strict=True)), key=str)


def sample_rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 400))) for _ in range(25)]
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(rnd.randint(0, 4)):
            w = t.split()
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w))
    rows += ["", None, " \n\t", "one", "One", "one two", "ÀB c d", base[0], base[0].upper(), "x y z " * 3000]
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return [*out, (1, base[0]), (None, "a null id"), (out[-1][0], out[-1][1])]


@pytest.mark.parametrize("root_rows", [20000, 4])
def test_matches_brute_force(spark, root_rows):
    rows = sample_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = near_components(docs, root_rows=root_rows)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_hot_roots_split_exactly(spark):
    from corvane.llm.simhash import near_edges

    rnd = random.Random(3)
    centre = rnd.getrandbits(63)
    fps = {centre}
    for _ in range(150):
        fps.add(rnd.choice(sorted(fps)) ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(1, 3))))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def groups():
        out = {}
        for f in fps:
            out.setdefault(root(f), set()).add(f)
        return {frozenset(g) for g in out.values()}

    for r in near_edges(df, root_rows=5).collect():
        assert (r.a != r.b)
        parent[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    got = groups()
    parent = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == groups()


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_leaves_other_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d", 1), (1, "A b c d", 2), (3, "quite other words here", 3)], "doc_id long, text string, component_id int")
    assert sorted(keep_one(docs).collect()) == [(1, "A b c d", 2), (3, "quite other words here", 3)]


def test_simhash_of_long_text():
    text = "alpha beta gamma delta " * 20000
    assert simhash(text) == brute_fp(text)
