import pytest

from corvane.sources.remote import DownloadPlan, Retry, download, pages, total
from corvane.streaming.ingest import latest, read_table_stream, run_upsert, windowed_counts


def server(request):
    if "_summary" in request:
        return {"total": 3}
    if request.startswith("Patient?"):
        return {"resourceType": "Bundle", "type": "searchset", "entry": [{"resource": {"resourceType": "Patient", "id": "1", "meta": {"lastUpdated": "2024-02-01"}}}], "link": [{"relation": "next", "url": "page2"}]}
    if request == "page2":
        return {"resourceType": "Bundle", "type": "searchset", "entry": [{"resource": {"resourceType": "Patient", "id": "2", "birthDate": "2020-01-01T10:00:00", "meta": {"lastUpdated": "2024-01-01"}}}]}
    return {"resourceType": "OperationOutcome", "issue": [{"code": "x"}]}


def test_pages_follow_links_and_survive_failures(spark):
    plan = DownloadPlan({"Patient": {"address-city": "Ann Arbor"}, "Encounter": {}, "Group": {"_lastUpdated": "gt2020", "_sort": "status"}}, {"Patient": "2023-01-01", "Group": "x"})
    assert plan.first_request("Patient") == "Patient?address-city=Ann%20Arbor&_sort=_lastUpdated&_lastUpdated=gt2023-01-01"
    assert plan.first_request("Group") == "Group?_lastUpdated=gt2020&_sort=status"
    assert total(plan, server) == 9
    got = list(pages(plan, server))
    assert [(e is None, [r["id"] for r in rs]) for _, e, rs in got] == [(True, ["1"]), (True, ["2"]), (False, []), (False, [])]
    assert plan.marks["Patient"] == "2024-02-01"
    frames = list(download(spark, plan, server))
    assert [f.first().status for f in frames] == ["success", "success", "failure", "failure"]
    assert '"birthDate": "2020-01-01"' in frames[1].first().json.replace('":"', '": "')
    assert plan.accept({"resourceType": "Bundle", "type": "history"}) == ([], None)


def test_retry():
    waits, tries = [], []

    def job():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("no")
        return "done"

    assert Retry(3, 2, True).run(job, waits.append) == "done" and waits == [2, 4, 8]
    with pytest.raises(OSError):
        Retry(1, 1).run(lambda: (_ for _ in ()).throw(OSError()), waits.append)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", i % 7, None if i % 5 == 0 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, day string, user_id long, value double").selectExpr("event_id", "cast(day as timestamp_ntz) ts", "user_id", "value")
    df.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = run_upsert(spark, read_table_stream(spark, str(tmp_path), "events"), ["user_id"], ["ts", "event_id"], f"file://{tmp_path}/out")
    want = latest(df, ["user_id"], ["ts", "event_id"])
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 7


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:10", "a"), ("2024-01-01 05:00:00", "b")], "ts string, k string").selectExpr("cast(ts as timestamp_ntz) ts", "k").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    out = windowed_counts(read_table_stream(spark, str(tmp_path), "t"), "ts", ["k"], "1 minute", "5 minutes")
    q = out.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").where("k = 'a'").count() == 2
