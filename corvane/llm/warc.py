"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames of whole records, then a
skippable frame with the record index (record id -> frame, offset inside the
decompressed frame), then the seek table of the public Zstandard seekable
format. Any record can be read with one seek and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import shared_dir

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
SPACE = uuid.UUID("6f1f4a5e-7f0b-4c1e-9f55-3c1f4a8be0d1")
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PLACE = "record_id string, file string, frame int, offset long, page_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """A response, or a revisit of page ``refers_to`` that has the same payload."""
    rid, revisit = record_id(page_id, digest), refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", rid),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return rid, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that begins at ``at``; a response's digest is verified."""
    if not data.startswith(b"WARC/1.1\r\n", at):
        raise ValueError("no WARC record here")
    cut = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:])
    end = cut + 4 + int(head["Content-Length"])
    block = data[cut + 4 : end]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if head["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if head["WARC-Payload-Digest"] != f"sha1:{found}" or len(payload) != int(head["X-Payload-Length"]):
            raise ValueError(f"digest differs in {head['WARC-Record-ID']}")
    return head, payload, end + 4


class BundleWriter:
    """Writes records to one bundle; frames close at ``frame_bytes`` of records."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        self.out, self.frame_bytes, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.index: dict[str, tuple[int, int]] = {}
        self.held, self.size, self.total = [], 0, 0

    def add(self, rid: str, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._close_frame()
        place = (len(self.frames), self.size)
        self.index[rid] = place
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        return place

    def _close_frame(self) -> None:
        packed = self.zip.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._close_frame()
        index = self.zip.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in [*self.frames, (len(index) + 8, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access by frame or record id through the footer's seek table."""

    def __init__(self, src):
        self.src, end = src, src.size()
        src.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", src.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        src.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", src.read(8 * n)))
        self.starts, at = [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.sizes = sizes

    def __len__(self) -> int:
        return len(self.sizes) - 1

    def frame(self, k: int) -> bytes:
        self.src.seek(self.starts[k])
        packed, size = self.sizes[k]
        return zstandard.ZstdDecompressor().decompress(self.src.read(packed), max_output_size=size)

    def index(self) -> dict[str, tuple[int, int]]:
        self.src.seek(self.starts[-1] + 8)
        return json.loads(zstandard.ZstdDecompressor().decompress(self.src.read(self.sizes[-1][0] - 8)))

    def record(self, rid: str) -> tuple[dict[str, str], bytes]:
        k, at = self.index()[rid]
        return parse_record(self.frame(k), at)[:2]


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: which rows become revisits, and of which page.

    Only ids and digests are grouped and joined by digest; the payloads move
    once, by page_id, so that one very common payload stays spread out.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    tops = ids.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    again = ids.join(tops, "digest").where("page_id < top").select("page_id", "digest", F.col("top").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "digest"], "left")


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Writes the planned records below ``folder`` and returns the index ``(record_id, file, frame, offset, page_id)``.

    A task writes bundles of at most ``bundle_bytes`` of records plus one
    record. Each attempt has file names of its own and the index is stored as
    Parquet beside them, so a task that runs again (a lost executor) never
    changes a file that the index names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        bundle: BundleWriter | None = None
        name, rows = "", []

        def done() -> Iterator[pa.RecordBatch]:
            bundle.close()
            cols = list(zip(*rows, strict=True))
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["record_id", "file", "frame", "offset", "page_id"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name, rows = f"bundle-{uuid.uuid4().hex}.warc.zst", []
                    bundle = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                rid, data = make_record(page_id, url, payload, digest, refers_to)
                rows.append((rid, name, *bundle.add(rid, data), page_id))
                if bundle.total >= bundle_bytes:
                    yield from done()
                    bundle = None
        if bundle is not None:
            yield from done()

    planned = records.select("page_id", "url", "payload", "digest", "refers_to")
    planned.mapInArrow(run, PLACE).write.parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the frames that ``index`` names, parsed and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        at, reader = None, None
        for batch in batches:
            for file, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    at, reader = file, BundleReader(fs.open_input_file(f"{root}/{file}"))
                data, end, rows = reader.frame(frame), 0, []
                while end < len(data):
                    head, payload, end = parse_record(data, end)
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page, to = head["X-Page-Id"], head.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(to) if to else None, head["WARC-Record-ID"], head["WARC-Target-URI"], payload))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                cols = zip(*rows, strict=True)
                names = [x.split()[0] for x in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    frames = index.groupBy("file", "frame").agg(F.count("*").alias("n")).select("file", "frame")
    return frames.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> tuple[str, DataFrame]:
    """Archives ``pages(page_id, url, html)``; returns the folder and the records read back.

    Of rows with equal payloads of at least ``least_bytes`` the one with the
    largest page_id is the response and the others revisit it; repeated rows
    with that page_id are all responses. Null html is an empty payload, null
    urls are empty, a null page_id is archived as a response and read back as
    null; other columns are ignored; an empty table writes no bundle.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(plan_records(pages, least_bytes), folder)
    return folder, read_bundles(index, folder)


def remove_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
