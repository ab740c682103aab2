"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then the leading
tokens, where a token with a digit is a variable field, then the part of the
line that varies. A line so has several templates: itself with its fields, and,
for each of ``PARTS`` parts of what follows the leading tokens, the line with
that part as one variable field. The first recurs if it stands in two documents;
one with a variable part if it stands in ``MIN_DOCS``, which tells a field from
two sentences with one beginning. A line of which more than half is fields (a
row of numbers) says too little without them and is its own only template, as it
stands. A line goes if one of its templates recurs and stands in a document
with a smaller id. Whether it goes does not depend on what else is in its leaf.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.warc import remove_folder
from corvane.session import cut_lineage, free_shuffles, shared_dir, stored

FIELD = b"<*>"
LEADING, PARTS, MIN_DOCS = 3, 4, 3
DIGIT = re.compile(rb"[0-9]")
NO_ID = -(2**63)


def masked_tokens(line: bytes) -> list[bytes]:
    """Tokens of a line (ASCII white space between them), those with a digit as fields."""
    tokens = line.split()
    return [FIELD if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def templates(line: bytes, leading: int = LEADING, parts: int = PARTS) -> list[bytes]:
    """Names of a line's templates, the line's own first; none for a blank line."""
    tokens = masked_tokens(line)
    n = len(tokens)
    if not n:
        return []
    if 2 * tokens.count(FIELD) > n:
        return [b"row " + b" ".join(line.split())]
    out, rest = [b"line " + b" ".join(tokens)], n - leading
    for j in range(parts if rest > 0 else 0):
        a, b = leading + j * rest // parts, leading + (j + 1) * rest // parts
        if a < b:
            out.append(b"%d %d " % (n, j) + b" ".join(tokens[:a] + tokens[b:]))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc"), F.xxhash64(text).alias("own"), text.alias("text"))


def parsed_lines(docs: DataFrame, leading: int = LEADING, parts: int = PARTS) -> DataFrame:
    """``(doc, own, line, template)`` for each template of each line; ``own`` is the hash of the whole text.

    The last bit of a template's number tells that a part of it varies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, names = [], [], []
            for row, text in enumerate(batch.column(2)):
                for place, line in enumerate(text.as_py().encode().split(b"\n")):
                    found = templates(line, leading, parts)
                    rows += [row] * len(found)
                    lines += [place] * len(found)
                    names += [xxhash.xxh3_64_intdigest(x) & ~1 | (k > 0) for k, x in enumerate(found)]
            at = pa.array(rows, pa.int64())
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.int32()), pa.array(np.array(names, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "own", "line", "template"])

    return _keyed(docs).mapInArrow(run, "doc long, own long, line int, template long")


def _apart(df: DataFrame, key: str) -> DataFrame:
    """Hide an aggregate's partitioning, so that AQE can split a hot key's side of the join."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, parts: int = PARTS) -> DataFrame:
    """``(doc, own, drops array<int>)``: the line numbers that each text loses; texts that lose none are left out.

    Templates of a single document go first, which needs no list of documents;
    the documents of the others are counted among their lines. Rows of lines
    leave the disk as soon as they are not read any more, before texts move.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = stored(parsed_lines(docs, leading, parts), f"{folder}/all")
    general = F.col("template").bitwiseAND(F.lit(1).cast("long")) == 1
    spread = lines.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    spread = spread.where((F.col("first") < F.col("last")) & (~general | (F.col("n") >= min_docs))).select("template", "first")
    hits = stored(lines.join(_apart(spread, "template"), "template"), f"{folder}/hits")
    remove_folder(spark, f"{folder}/all")
    del lines, spread
    free_shuffles(spark)
    known = hits.where(general).select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    lost = hits.where(~general).unionByName(hits.where(general).join(_apart(known, "template"), "template").drop("n")).where("doc <> first")
    found = cut_lineage(lost.groupBy("doc", "own").agg(F.collect_set("line").alias("drops")))
    remove_folder(spark, folder)
    del hits, known, lost
    free_shuffles(spark)
    return found


def drop_lines(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and the columns ``n_lines`` and ``n_dropped``.

    Lines are separated by a line feed; blank lines always stay. Null texts
    become empty (no line); rows without an id share one id, before all others;
    each row loses lines of its own text only, also where rows share an id;
    rows repeated whole are treated alike; a line that recurs within one
    document, or only in rows of one id, stays; other columns pass through
    (``n_lines`` and ``n_dropped`` are replaced); an empty table gives an empty
    result.
    """
    found = recurring_lines(docs, **rules).select(F.col("doc").alias("__doc"), F.col("own").alias("__own"), F.col("drops").alias("__drops"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID).cast("long"))
    out = docs.join(found, (key == F.col("__doc")) & (F.xxhash64(text) == F.col("__own")), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains(F.col("__drops"), k)), "\n")
    counted = {"n_lines": F.when(text == "", 0).otherwise(F.size(lines)).cast("long"), "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long")}
    out = out.withColumns({**counted, "text": F.when(F.col("__drops").isNull(), text).otherwise(kept)})
    return out.drop("__doc", "__own", "__drops")


def kept_digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)
