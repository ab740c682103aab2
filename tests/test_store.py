import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import changes, ordering
from corvane.operators.bundles import UploadStrategy, bundle_entries, map_responses, pack_groups
from corvane.operators.criteria import Date, Modifier, Number, Quantity, Reference, Text, Token, contact_token, token_of
from corvane.operators.search import Search
from corvane.operators.sync import accept_local, accept_remote, rewrite_ids, rewrite_log
from corvane.sources.store import Conflict, NotFound, PendingChanges, Store, run_sync


def docs(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "json string")


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "resource_type string, resource_id string")


PEOPLE = [
    {"resourceType": "Patient", "id": "a", "gender": "male", "name": [{"family": "Abel", "given": ["Zoe"]}, {"family": "Zorn"}], "birthDate": "1980-05-01"},
    {"resourceType": "Patient", "id": "b", "gender": "female", "name": [{"family": "école"}], "birthDate": "1990"},
    {"resourceType": "Patient", "id": "c", "gender": "female"},
    {"resourceType": "Observation", "id": "o1", "subject": {"reference": "Patient/a"}, "code": {"coding": [{"system": "s", "code": "w"}]}, "valueQuantity": {"value": 5.403, "unit": "g", "system": "http://unitsofmeasure.org", "code": "g"}, "effectiveDateTime": "2013-03-14T10:00:00Z"},
    {"resourceType": "Observation", "id": "o2", "subject": {"reference": "Patient/a"}, "code": {"coding": [{"system": "s", "code": "v"}]}, "effectiveDateTime": "2014-01-01"},
    {"resourceType": "Observation", "id": "o3", "subject": {"reference": "Group/a"}, "code": {"coding": [{"code": "w"}]}},
    {"resourceType": "RiskAssessment", "id": "r", "prediction": [{"probabilityDecimal": 99.996}], "subject": {"reference": "Patient/b"}},
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}", clock=lambda: F.lit("2024-01-01 00:00:00").cast("timestamp"))
    s.create(docs(spark, *PEOPLE))
    return s


def found(store, request):
    return [r.resource_id for r in store.search(request).collect()]


@pytest.mark.parametrize(
    ("request_", "want"),
    [
        (lambda: Search("Patient").filter("family", Text("ABEL")), {"a"}), (lambda: Search("Patient").filter("family", Text("ÉCOLE")), set()),
        (lambda: Search("Patient").filter("family", Text("orn", Modifier.CONTAINS)), {"a"}), (lambda: Search("Patient").filter("family", Text("abel", Modifier.EXACT)), set()),
        (lambda: Search("Patient").filter("gender", *token_of("female")), {"b", "c"}), (lambda: Search("Patient").filter("family"), {"a", "b"}),
        (lambda: Search("Patient", operation="or").filter("gender", Token("male")).filter("birthdate", Date("1990", "eq")), {"a", "b"}),
        (lambda: Search("Patient").filter("birthdate", Date("1990-06", "ne")), {"a", "b"}), (lambda: Search("Patient").filter("birthdate", Date("1985", "sa")), {"b"}),
        (lambda: Search("Patient").has("Observation", "subject", lambda o: o.filter("code", Token("w", "s"))), {"a"}), (lambda: Search("Patient").has("Observation", "subject"), {"a"}),
        (lambda: Search("Observation").filter("code", *token_of({"coding": [{"system": "s", "code": "w"}, {"system": "s", "code": "v"}]})), {"o1", "o2"}),
        (lambda: Search("Observation").filter("value-quantity", Quantity("5403", system="http://unitsofmeasure.org", unit="mg")), {"o1"}),
        (lambda: Search("Observation").filter("value-quantity", Quantity("5.403", unit="g")), {"o1"}), (lambda: Search("Observation").filter("value-quantity", Quantity("5.40", unit="g")), {"o1"}),
        (lambda: Search("Observation").filter("date", Date("2013-03-14")), {"o1"}), (lambda: Search("Observation").filter("date", Date("2013-03-14T10:00:00Z")), {"o1"}),
        (lambda: Search("Observation").filter("subject", Reference("Patient/a")), {"o1", "o2"}), (lambda: Search("RiskAssessment").filter("probability", Number("100.00")), {"r"}),
        (lambda: Search("Patient").filter("family", Text("Abel", Modifier.EXACT), Text("Zorn", Modifier.EXACT), operation="and"), set()),
        (lambda: Search("Patient").filter("family", Text("Abel", Modifier.EXACT)).filter("family", Text("Zorn", Modifier.EXACT)), {"a"}),
        (lambda: Search("Patient").filter("local_lastUpdated", Date("2024", "eq")), {"a", "b", "c"}),
        (lambda: "Observation?code=s|w&subject=Patient/a", {"o1"}), (lambda: "Patient?_id=a,c", {"a", "c"}),
    ],
)
def test_search(store, request_, want):
    assert set(found(store, request_())) == want
    assert store.count(request_()) == len(want)


def test_order_and_pages(store):
    assert found(store, Search("Patient").sort("family"))[2:] == ["c"] and found(store, Search("Patient").sort("family", descending=True))[-1] == "c"
    assert len(found(store, "Patient?_sort=family&_count=1&_offset=1")) == 1
    with pytest.raises(NotImplementedError):
        store.search(Search("Patient").sort("gender"))
    with pytest.raises(ValueError):
        store.search("Patient?nope=1")
    with pytest.raises(ValueError):
        store.search(Search("RiskAssessment").filter("probability", Number("5", "sa")))


def test_includes(store):
    key = {r.uuid: r.resource_id for r in store.resources.collect()}
    got = store.included(Search("Patient").rev_include("Observation", "subject", lambda o: o.sort("date", descending=True)).rev_include("RiskAssessment", "subject")).collect()
    assert sorted((key[r.base_id], r.type, key[r.resource_id], r.rank) for r in got) == [("a", "Observation", "o1", 2), ("a", "Observation", "o2", 1), ("b", "RiskAssessment", "r", None)]
    rows = {key[r.base_id]: r for r in store.stitched(Search("Observation").include("Patient", "subject")).collect()}
    assert [key[x] for x in rows["o1"].included["subject"]] == ["a"] and rows["o3"].included is None


def test_write_update_delete_purge_clear(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create(docs(spark, *PEOPLE[:2], {"resourceType": "Patient"}))
    assert s.resources.count() == 3 and s.log.count() == 3
    s.update(docs(spark, {**PEOPLE[0], "gender": "other"}))
    s.update(docs(spark, {**PEOPLE[0], "gender": "other"}))
    assert json.loads(s.get("Patient", "a"))["gender"] == "other"
    assert [r.type for r in s.local_changes("Patient", "a").collect()] == ["INSERT", "UPDATE"]
    with pytest.raises(NotFound):
        s.update(docs(spark, {"resourceType": "Patient", "id": "zz"}))
    with pytest.raises(NotFound):
        s.get("Patient", "zz")
    patches = {r.resource_id: r for r in changes.squash(s.log).collect()}
    assert json.loads(patches["a"].payload)["gender"] == "other" and patches["a"].type == "INSERT" and len(patches["a"].token) == 2
    s.delete(ids(spark, ("Patient", "a"), ("Patient", "unknown")))
    assert {r.resource_id: r.type for r in changes.squash(s.log).collect()}["a"] is None
    assert s.count(Search("Patient").filter("gender", Token("other"))) == 0
    with pytest.raises(PendingChanges):
        s.purge(ids(spark, ("Patient", "b")))
    s.purge(ids(spark, ("Patient", "b")), force=True)
    assert s.resources.where("resource_id = 'b'").count() == 0 and s.log.where("resource_id = 'b'").count() == 0

    def broken(t):
        t.clear()
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        s.transaction(broken)
    assert s.resources.count() == 1
    s.clear()
    s.vacuum()
    assert s.resources.count() == 0 and s.index.count() == 0


def test_sync(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    page = docs(spark, {**PEOPLE[0], "meta": {"versionId": "1"}}, PEOPLE[1])
    s.sync_download([page])
    assert s.log.count() == 0 and s.last_sync()
    s.update(docs(spark, {**PEOPLE[0], "gender": "unknown"}))
    s.sync_download([docs(spark, {**PEOPLE[0], "gender": "other"})], accept_local)
    assert json.loads(s.get("Patient", "a"))["gender"] == "unknown" and [r.type for r in s.log.collect()] == ["UPDATE"]
    s.sync_download([docs(spark, {**PEOPLE[0], "gender": "other"})], accept_remote)
    assert json.loads(s.get("Patient", "a"))["gender"] == "other" and s.log.count() == 0
    s.create(docs(spark, PEOPLE[2]))
    sent = []

    def send(entries):
        sent.extend(entries.collect())
        return entries.select("resource_type", "resource_id", F.lit(True).alias("ok"), F.lit("9").alias("version_id"), F.lit(None).cast("timestamp").alias("last_updated"))

    s.sync_upload(send)
    assert [(r.verb, r.url) for r in sent] == [("PUT", "Patient/c")] and s.log.count() == 0
    assert s.resources.where("resource_id = 'c'").first().version_id == "9"


def test_rewriting_ids(spark):
    res = spark.createDataFrame([("Patient", "1", '{"id":"1"}'), ("Observation", "5", '{"id":"5","subject":{"reference":"Patient/1"}}'), ("Group", "1", '{"id":"1"}')], "resource_type string, resource_id string, json string")
    new = spark.createDataFrame([("Patient", "1", "new")], "resource_type string, old_id string, new_id string")
    got = {(r.resource_type, r.resource_id): (json.loads(r.json), r.rewritten) for r in rewrite_ids(res, new).collect()}
    assert got == {("Patient", "new"): ({"id": "new"}, False), ("Observation", "5"): ({"id": "5", "subject": {"reference": "Patient/new"}}, True), ("Group", "1"): ({"id": "1"}, False)}
    log = spark.createDataFrame([(1, "Patient", "1", "INSERT", '{"id":"1"}'), (2, "Observation", "5", "UPDATE", '[{"op":"replace","path":"/subject/reference","value":"Patient/1"}]'), (3, "Patient", "1", "DELETE", "")], "seq long, resource_type string, resource_id string, type string, payload string")
    out = {r.seq: r for r in rewrite_log(log, new).collect()}
    assert json.loads(out[2].payload)[0]["value"] == "Patient/new" and out[3].payload == "" and out[1].resource_id == "new" and json.loads(out[1].payload)["id"] == "new"


def test_order_of_groups(spark):
    nodes = spark.createDataFrame([(n,) for n in "p1 r1 p2 r2 e1 o1 p3 e2 o2".split()], "node string")
    pairs = [("p1", "r1"), ("r1", "p1"), ("p2", "r2"), ("r2", "p2"), ("e1", "p1"), ("o1", "e1"), ("o1", "p1"), ("e2", "p3"), ("o2", "e2"), ("o2", "o2")]
    got = {r.node: (r.component, r.level) for r in ordering.ordered_groups(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {"p1": ("p1", 0), "r1": ("p1", 0), "p2": ("p2", 0), "r2": ("p2", 0), "p3": ("p3", 0), "e1": ("e1", 1), "e2": ("e2", 1), "o1": ("o1", 2), "o2": ("o2", 2)}
    alone = ordering.ordered_groups(nodes, spark.createDataFrame([], "src string, dst string"))
    assert alone.where("node = component and level = 0").count() == 9
    with pytest.raises(ValueError):
        ordering.levels(nodes, spark.createDataFrame([("p1", "r1"), ("r1", "p1")], "src string, dst string"))


def test_bundles(spark):
    sizes = spark.createDataFrame([(1, 3), (2, 2), (3, 10), (4, 1), (5, 4), (6, 1)], "position int, size int")
    assert [r.bundle for r in pack_groups(sizes, 5).orderBy("position").collect()] == [0, 0, 1, 2, 2, 3]
    rows = [("T", "1", "INSERT", "{}", "1"), ("T", "2", "UPDATE", "[]", "2"), ("T", "3", "DELETE", "", None)]
    patches = spark.createDataFrame(rows, "resource_type string, resource_id string, type string, payload string, version_id string")
    got = [(r.verb, r.url, r.if_match, r.body) for r in bundle_entries(patches).orderBy("resource_id").collect()]
    assert got == [("PUT", "T/1", None, "{}"), ("PATCH", "T/2", 'W/"2"', "W10="), ("DELETE", "T/3", None, None)]
    for bad in ({"update_verb": "PUT", "squash": False, "bundle": False}, {"squash": False}, {"create_verb": "PATCH"}):
        with pytest.raises(ValueError):
            UploadStrategy(**bad)
    asked = spark.createDataFrame([(0, 0, "T"), (0, 1, "T")], "bundle int, position int, resource_type string")
    told = spark.createDataFrame([(0, 0, 'W/"4"', "h/T/7/_history/4", 0)], "bundle int, position int, etag string, location string, n_issues int")
    out = {r.position: r for r in map_responses(asked, told).collect()}
    assert out[0].error is None and out[0].new_version == "4" and out[0].new_place.id == "7" and out[1].error == "no response"


def test_squash_errors_and_merges(spark):
    rows = [
        (1, "P", "1", "u1", "2024-01-01", "UPDATE", '[{"op":"replace","path":"/a","value":1}]', "v1"), (2, "P", "1", "u1", "2024-01-02", "UPDATE", '[{"op":"replace","path":"/a","value":2},{"op":"add","path":"/b","value":3}]', "v2"),
        (3, "P", "2", "u2", "2024-01-01", "UPDATE", "[]", None), (4, "P", "2", "u2", "2024-01-02", "DELETE", "", "v9"), (5, "P", "2", "u2", "2024-01-03", "INSERT", '{"id":"2"}', None),
        (6, "P", "3", "u3", "2024-01-01", "UPDATE", "[]", None), (7, "P", "3", "u3", "2024-01-02", "INSERT", "{}", None),
    ]
    log = spark.createDataFrame(rows, "seq long, resource_type string, resource_id string, resource_uuid string, ts string, type string, payload string, version_id string").withColumn("ts", F.to_timestamp("ts"))
    got = changes.squash(log).collect()
    by = {(r.resource_id, tuple(r.token)): r for r in got}
    one = by["1", (1, 2)]
    assert json.loads(one.payload) == [{"op": "replace", "path": "/a", "value": 2}, {"op": "add", "path": "/b", "value": 3}] and one.version_id == "v1" and one.valid
    assert by["2", (3, 4)].type == "DELETE" and by["2", (5,)].type == "INSERT" and not by["3", (6, 7)].valid
    assert changes.discard(log, changes.squash(log).where("resource_id = '1'")).count() == 5


def test_contact_token():
    assert contact_token("555", "home") == Token("555", "home")


def test_a_crash_between_the_steps_of_a_write_changes_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create(docs(spark, *PEOPLE))
    for step in ("_point", "_snapshot"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                s.delete(s.resources.select("resource_type", "resource_id") if step == "_point" else docs(spark, PEOPLE[0]))
        again = Store(spark, f"file://{tmp_path}/s")
        assert again.resources.count() == len(PEOPLE) and again.log.count() == len(PEOPLE)
    s.vacuum()
    assert Store(spark, f"file://{tmp_path}/s").resources.count() == len(PEOPLE)


def test_state_leaves_data_files_alone_and_two_writers_do_not_mix(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create(docs(spark, PEOPLE[0]))
    before = {p: p.stat().st_mtime_ns for n in ("resources", "index", "log") for p in tmp_path.rglob(f"{n}/**/*.parquet")}
    s.set_state("a", "1")
    s.set_states({"a": "2", "b": "3"})
    after = {p: p.stat().st_mtime_ns for n in ("resources", "index", "log") for p in tmp_path.rglob(f"{n}/**/*.parquet")}
    assert before == after and s.get_state("a") == "2" and s.get_state("b") == "3" and s.resources.count() == 1
    with pytest.raises(Conflict):
        s._point("{}", s._numbers()[-1], "other")
    assert s.resources.count() == 1


def test_the_last_of_two_documents_with_one_id_is_stored_and_both_are_logged(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create(docs(spark, {**PEOPLE[0], "gender": "male"}, {**PEOPLE[0], "gender": "other"}).coalesce(1))
    assert s.resources.count() == 1 and json.loads(s.get("Patient", "a"))["gender"] == "other"
    assert [json.loads(r.payload)["gender"] for r in s.log.orderBy("seq").collect()] == ["male", "other"]


def test_upload_goes_by_references_stops_at_a_failure_and_takes_new_ids(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    seen = {"resourceType": "Observation", "id": "o1", "status": "final", "subject": {"reference": "Patient/a"}}
    s.create(docs(spark, seen, PEOPLE[0]))
    sent, fail = [], {"Observation/o1"}

    def send(entries):
        rows = entries.collect()
        sent.append([(r.resource_type, r.resource_id, r.payload) for r in rows])
        out = [(r.resource_type, r.resource_id, f"{r.resource_type}/{r.resource_id}" not in fail, "2", None, "srv" if r.resource_id == "a" else None) for r in rows]
        return spark.createDataFrame(out, "resource_type string, resource_id string, ok boolean, version_id string, last_updated timestamp, new_id string")

    result = run_sync(s, [], send, strategy=UploadStrategy(create_verb="POST", bundle_size=1))
    assert [[x[:2] for x in b] for b in sent] == [[("Patient", "a")], [("Observation", "o1")]]
    assert json.loads(sent[1][0][2])["subject"] == {"reference": "Patient/srv"}
    assert result.status == "failed" and result.errors == ("upload: Observation/o1",) and s.get_state("sync_status") == "failed"
    assert [r.resource_id for r in s.log.collect()] == ["o1"] and json.loads(s.get("Patient", "srv"))["id"] == "srv"
    assert json.loads(s.get("Observation", "o1"))["subject"] == {"reference": "Patient/srv"}
    fail.clear()
    heard = []
    page = docs(spark, {**PEOPLE[1], "meta": {"versionId": "1"}})
    result = run_sync(s, [page], send, progress=lambda step, n: heard.append((step, n)))
    assert result.status == "succeeded" and heard == [("download", 1), ("upload", 1)] and s.log.isEmpty() and s.last_sync()
    assert run_sync(s, [page], send, cancelled=lambda: True).status == "cancelled"
    assert s.search("Observation?subject=Patient/srv").count() == 1


def test_components_and_levels_have_no_cap(spark):
    names = [f"n{i:02d}" for i in range(12)]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    dense = [(a, b) for k, a in enumerate(names[:6]) for b in names[:k]] + [(names[6], names[7]), (names[7], names[8]), (names[8], names[6]), (names[9], names[6])]
    edges = spark.createDataFrame(dense, "src string, dst string")
    got = {r.node: r.component for r in ordering.strongly_connected(nodes, edges).collect()}
    assert got == {n: "n06" if n in ("n06", "n07", "n08") else n for n in names}
    assert {r.node: r.level for r in ordering.levels(nodes.where("node < 'n06'"), edges.where("src < 'n06'")).collect()} == {f"n{i:02d}": i for i in range(6)}
