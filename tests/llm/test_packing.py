import random
from collections import defaultdict

from corvane.llm.packing import best_fit, measure, pack


def brute_fit(pieces, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = []
        for k, b in enumerate(bins):
            room = capacity - sum(x[0] for x in b)
            clash = cluster is not None and any(x[2] == cluster for x in b)
            full = source is not None and sum(x[1] == source for x in b) >= per_source
            if room >= length and not clash and not full:
                fits.append((room, k))
        if fits:
            room, k = min(fits)
        else:
            bins.append([])
            room, k = capacity, len(bins) - 1
        out.append((k, capacity - room))
        bins[k].append((length, source, cluster))
    return out


def test_takes_the_tightest_compatible_bin():
    rnd = random.Random(1)
    for case in range(40):
        pieces = [(rnd.randint(1, 30), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, *range(1 + case)])) for _ in range(120)]
        pieces.sort(key=lambda p: -p[0])
        per_source = rnd.randint(1, 3)
        assert best_fit(pieces, 40, per_source) == brute_fit(pieces, 40, per_source)


def test_pack_keeps_every_token_and_every_rule(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 7, 40, 100, 101, 350]) if i % 3 else 33, None if i % 17 == 0 else f"s{i % 2}", i % 5 if i % 4 else 0) for i in range(400)]
    rows += [(None, 5, None, None), (7, None, "s", 1), (8, 20, "s", 1), (8, 20, "s", 1)]
    sized = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, n_tokens long, source string, cluster long, bin_id int, piece string")
    for shard in (50, 5000):
        got = pack(sized.repartition(4), capacity=100, per_source=2, shard_pieces=shard).collect()
        again = pack(sized.repartition(2), capacity=100, per_source=2, shard_pieces=shard).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        total, bins = defaultdict(int), defaultdict(list)
        for r in got:
            total[r.doc_id] += r.n_tokens
            if r.n_tokens:
                bins[r.bin_id].append(r)
            else:
                assert r.bin_id is None
        want = defaultdict(int)
        for i, n, *_ in rows:
            want[i] += n or 0
        assert total == want
        for b in bins.values():
            b.sort(key=lambda r: r.offset)
            assert b[0].offset == 0 and all(x.offset + x.n_tokens == y.offset for x, y in zip(b, b[1:], strict=False))
            assert b[-1].offset + b[-1].n_tokens <= 100
            assert len([r.cluster for r in b if r.cluster is not None]) == len({r.cluster for r in b if r.cluster is not None})
            by = defaultdict(int)
            for r in b:
                by[r.source] += r.source is not None
            assert max(by.values()) <= 2
    assert pack(sized.limit(0)).count() == 0


def test_measure_and_one_hot_cluster(spark):
    docs = spark.createDataFrame([(i, "same words here", "hot") for i in range(300)] + [(999, None, None)], "doc_id long, text string, source string")
    sized = measure(docs)
    assert sized.select("cluster").distinct().count() == 2
    got = pack(sized, capacity=10).collect()
    assert len({r.bin_id for r in got if r.n_tokens}) == 300
