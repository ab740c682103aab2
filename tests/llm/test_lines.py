import os
import random
from collections import defaultdict

from corvane.llm.lines import drop_lines
from corvane.session import shared_dir


def mask(line):
    return tuple("<*>" if any(c in "0123456789" for c in t) else t for t in line.encode().decode().split())


def forms(line, leading=3, parts=4):
    """Every template of a line as a tuple, and the documents that it takes."""
    m, raw = mask(line), tuple(line.split())
    if 2 * m.count("<*>") > len(m):
        return {("row", raw): 2}
    out = {("line", m): 2} if m else {}
    for j in range(parts):
        a, b = (leading + k * (len(m) - leading) // parts for k in (j, j + 1))
        if len(m) > leading and a < b:
            out[len(m), j, tuple(x for k, x in enumerate(m) if not a <= k < b)] = 3
    return out


def brute(rows):
    docs = {i: (t or "").split("\n") for i, t in rows}
    holders = defaultdict(set)
    for i, lines in docs.items():
        for line in lines:
            for f in forms(line):
                holders[f].add(i)
    low = lambda ids: min(ids, key=lambda x: (x is not None, x or 0))
    out = {}
    for i, lines in docs.items():
        kept = [line for line in lines if not any(len(holders[f]) >= n and low(holders[f]) != i for f, n in forms(line).items())]
        out[i] = (0 if lines == [""] else len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    stock = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(0, 8)):
            kind = rnd.random()
            if kind < 0.4:
                lines.append(rnd.choice(stock))
            elif kind < 0.6:
                lines.append(f"user id{rnd.randrange(99)} logged in from 10.0.{rnd.randrange(9)} at {rnd.randrange(9)}h")
            elif kind < 0.75:
                lines.append(f"the license of {rnd.choice('ABCDEFG')} covers all of these files")
            else:
                lines.append(" ".join(rnd.choices(words, k=rnd.randint(0, 12))))
        rows.append((i * 2, "\n".join(lines)))
    rows += [(501, None), (502, ""), (503, "\n\n"), (504, "a b c d\n" * 5000), (505, "a  b\tc d"), (506, "a b c d"), (None, "a b c d"), (507, rows[0][1]), (508, "é é é é\r"), (509, "1 2 3 4 5"), (510, "1 2 3 4 6"), (511, "1 2 3 9 5"), (512, "1 2  3 4 5\nShare\nPage 3\n7"), (513, "Share\nPage 4\n8\n7")]
    docs = spark.createDataFrame([(i, t, "x", 3, 9) for i, t in rows], "doc_id long, text string, line string, drops int, n_lines int").repartition(3)
    want = brute(rows)
    got = drop_lines(docs).collect()
    assert len(got) == len(rows) and {"line", "drops"} <= set(got[0].asDict())
    for r in got:
        assert (r.n_lines, r.n_dropped, r.text) == want[r.doc_id]
    assert sum(r.n_dropped for r in got) > 50


def test_repeated_rows_and_empty_table(spark):
    rows = [(i, "one two three four\nown line of number") for i in (1, 1, 2, 3)]
    got = sorted((r.doc_id, r.n_dropped) for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 2), (3, 2)]
    assert drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_with_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "shared line\nfirst text"), (2, "unlike text\nnothing shared"), (2, "other one\nshared line"), (None, "new\nfour five"), (None, "shared line")]
    got = sorted((str(r.doc_id), r.text) for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "first text"), ("2", rows[1][1]), ("2", "other one"), ("None", "new\nfour five"), ("None", "shared line")])


def test_unlike_lines_do_not_switch_a_template_off(spark):
    lines = [f"posted in the forum by {n} at night time" for n in ("ann", "bob", "cy", "dee")]
    unlike = [f"posted in the {a} {b} {c} {d} e{a} f{b}" for a, b, c, d in ("qrst", "uvwx", "yzkl")]
    docs = spark.createDataFrame(list(enumerate(lines + unlike)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in drop_lines(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}


def test_rows_of_lines_leave_the_disk(spark):
    rnd = random.Random(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    texts = ["\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(20)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t + "\nthe same last line") for i, t in enumerate(texts)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    held = lambda: sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)
    before = held()
    assert sum(r.n_dropped for r in drop_lines(docs).collect()) == 199
    assert held() - before < sum(map(len, texts)) / 2
