import random

import pytest

import corpus_pipeline
from corvane.llm.decontaminate import word_hashes
from corvane.llm.minhash import shingle_hashes
from corvane.llm.simhash import keep_one, near_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def document(rnd, n=120):
    return " ".join(rnd.choice(["re", "un", "on"]) + "".join(rnd.choices("aeioust", k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(4)
    folder = tmp_path_factory.mktemp("tables")
    good = [document(rnd, rnd.randint(60, 250)) for _ in range(80)]
    bench = [document(rnd, 30) for _ in range(5)]
    docs, labels = {}, []
    for i, t in enumerate(good):
        docs[i] = t
    docs[200], docs[201] = good[3], good[3]
    docs[202] = good[5].replace("un", "xx", 1)
    docs[203] = good[6] + " " + bench[2] + " " + document(rnd, 20)
    for i in range(300, 340):
        docs[i] = " ".join(w.upper() + "!!" for w in document(rnd).split())
    for i in docs:
        labels.append((i, 0 if i >= 300 else 1, 0))
    docs[400], docs[401] = None, ""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_stages_in_order_and_what_they_keep(spark, tables):
    folder, docs = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        now = spark.createDataFrame(out.collect(), COLUMNS)
        seen.append({r.doc_id for r in now.collect()})
    clean = set(range(80))
    assert clean <= seen[0] and not seen[0] & set(range(300, 340))
    assert seen[1] == seen[0] - {200, 201}
    assert clean - {203} <= seen[2] and not seen[2] & {200, 201, 202}
    assert seen[3] == seen[2] - {203}
    assert len(word_hashes(docs[203])) > 100


def test_run_packs_what_is_left(spark, tables):
    folder, docs = tables
    got = corpus_pipeline.run(spark, folder).collect()
    assert set(range(80)) <= {r.doc_id for r in got} and not {r.doc_id for r in got} & {200, 201, 202, 203, 310}
    assert sum(r.n_tokens for r in got if r.doc_id == 7) == len(docs[7].split())


def test_near_groups_against_all_pairs(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        base = document(rnd, rnd.choice([12, 40, 150, 600])).split()
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            w = list(base)
            for _ in range(max(1, len(w) // 90)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(999)}"
            rows.append(" ".join(w))
    rows += [None, "", "short one", "Short  one"]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(rows)], "doc_id long, text string, same string, fp int").repartition(3)
    got = {r.id: r.group_id for r in near_groups(docs).collect()}
    sets = [set(shingle_hashes(t or "").tolist()) for t in rows]
    hit = total = 0
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            j = len(sets[a] & sets[b]) / union if union else 1.0
            if j >= 0.84:
                total += 1
                hit += got[a] == got[b]
            elif j < 0.3:
                assert got[a] != got[b]
    assert total > 20 and hit >= 0.97 * total
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == set(got.values())
