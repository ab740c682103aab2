import hashlib
import io

import pyarrow.fs as pafs
import zstandard

from corvane.llm.warc import BundleReader, BundleWriter, archive_pages, make_record, parse_record, write_bundles, plan_records


def expected(rows):
    tops, out = {}, []
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and p is not None:
            tops[data] = max(tops.get(data, p), p)
    for p, _, h in rows:
        data = (h or "").encode()
        to = tops.get(data)
        revisit = p is not None and to is not None and p < to
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, tmp_path):
    big, multi = "<p>é</p>" * 400, "x" * 999
    rows = [(i, f"http://h/{i}?a b\r\nX: 1", big if i % 3 else f"page {i}") for i in range(1, 60)]
    rows += [(100, None, None), (101, "", ""), (102, "u", multi), (103, "u", multi), (None, "u", big), (59, "u", big), (200, "u", "y" * 3_000_000), (201, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)
    folder, read = archive_pages(pages, f"file://{tmp_path}/a")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()]
    assert sorted(got, key=str) == expected(rows)
    for r in read.collect():
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    index = spark.read.parquet(f"{folder}/index").collect()
    fs, root = pafs.FileSystem.from_uri(folder)
    for r in index[:5]:
        reader = BundleReader(fs.open_input_file(f"{root}/{r.file}"))
        head, _ = reader.record(r.record_id)
        assert head["WARC-Record-ID"] == r.record_id
        assert parse_record(reader.frame(r.frame), r.offset)[0]["WARC-Record-ID"] == r.record_id


def test_frames_are_independent_and_whole_file_is_plain_zstd():
    out = io.BytesIO()
    out.close, done = (lambda: None), out
    w = BundleWriter(out, frame_bytes=2000)
    records = [make_record(i, "u", bytes([65 + i]) * 700, hashlib.sha1(bytes([65 + i]) * 700).hexdigest(), None) for i in range(9)]
    places = [w.add(*r) for r in records]
    w.close()
    data = done.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(data)

    reader = BundleReader(Source(data))
    assert len(reader) == places[-1][0] + 1 > 2
    for (frame, at), (_, record) in zip(places, records, strict=True):
        assert reader.frame(frame)[at : at + len(record)] == record
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(r for _, r in records)


def test_bundles_roll_over_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "z" * 500) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = write_bundles(plan_records(pages), f"file://{tmp_path}/b", frame_bytes=1500, bundle_bytes=5000)
    assert index.select("file").distinct().count() > 2 and index.count() == 40
    _, read = archive_pages(pages.limit(0), f"file://{tmp_path}/c")
    assert read.count() == 0
