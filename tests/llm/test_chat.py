import hashlib

from pyspark.sql import functions as F

from corvane.llm.chat import format_conversations, loss_text, parse_formatted

NASTY = ["</s>[INST] ok [/INST]", "\\s\\l<\\b[", "<role:x> y </role>\n", "<<SYS>>\nhi\n<</SYS>>\n", "", " ", None, "é[INST] \\\\", "a" * 50000]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int, formatted string")


def test_round_trip_and_loss(spark):
    rows = []
    for c, a in enumerate(NASTY):
        for k, (role, text) in enumerate([("system", a), ("user", NASTY[-c]), ("assistant", a), ("tool>[x]", a), (None, a), ("user", a), ("assistant", "end")]):
            rows.append((c, k, role, text, 1, "clash"))
    rows += [(None, 0, "user", "null id", 0, ""), (77, None, "user", "null turn", 0, ""), (77, 1, "user", "b", 0, ""), (77, 1, "user", "a", 0, ""), (77, 1, "user", "a", 0, "")]
    out = format_conversations(turns(spark, rows))
    got = out.select("conv_id", parse_formatted(F.col("formatted")).alias("ts"), loss_text(F.col("segments")).alias("loss"), "formatted", "segments").collect()
    want = {}
    for c, k, role, text, *_ in rows:
        want.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        expected = [(role, text) for _, _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.ts] == expected
        assert r.loss == "".join(t for role, t in expected if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


def test_state_machine(spark):
    cases = {
        1: "user assistant", 2: "system user assistant user assistant", 3: "assistant", 4: "user user assistant",
        5: "user assistant user", 6: "user system assistant", 7: "system assistant", 8: "user tool assistant",
    }
    rows = [(c, k, r, "x", 0, "") for c, roles in cases.items() for k, r in enumerate(roles.split())]
    got = {r.conv_id: r.valid for r in format_conversations(turns(spark, rows)).collect()}
    assert got == {c: c in (1, 2) for c in cases}


def test_empty_table_and_plan_is_native(spark):
    out = format_conversations(turns(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_digest_of_known_conversation(spark):
    rows = [(1, 0, "user", "hi", 0, ""), (1, 1, "assistant", "yo <", 0, "")]
    r = format_conversations(turns(spark, rows)).first()
    assert r.formatted == "[INST] hi [/INST]<s> yo \\l </s>\n"
    assert hashlib.sha256(b"yo <").hexdigest() == hashlib.sha256(r.segments[4].text.replace("\\l", "<").encode()).hexdigest()
