"""Production queries over the whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.chat import format_conversations, loss_text, parse_formatted
from corvane.llm.decontaminate import find_leaks
from corvane.llm.lines import drop_lines, kept_digest
from corvane.llm.minhash import fingerprint_edits
from corvane.llm.packing import measure, pack
from corvane.llm.passages import remove_repeated_passages
from corvane.llm.quality import classify
from corvane.llm.simhash import near_components
from corvane.llm.suffix import remove_repeated_bytes
from corvane.llm.warc import archive_pages, remove_folder
from corvane.session import cut_lineage, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), budget=2, words_per_shingle=3)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_bytes(table(spark, sf_dir, "documents"), size=100)
    return left.select("doc_id", F.col("n_tokens").alias("n_bytes"), *_removed())


def _removed() -> tuple[Column, Column, Column]:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", kept_digest().alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), t AS (
  SELECT doc_id, k, r, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END for x in r] AS m
  FROM (SELECT doc_id, k, [x for x in string_split_regex(line, '[\x20\x09-\x0D]+') if x <> ''] AS r FROM l)
), f AS (
  SELECT *, 2 * len([x for x in m if x = '<*>']) > len(m) AS numbers FROM t WHERE len(m) > 0
), n AS (
  SELECT doc_id, k, 2 AS least, CASE WHEN numbers THEN 'row ' || array_to_string(r, ' ') ELSE 'line ' || array_to_string(m, ' ') END AS template FROM f
  UNION ALL
  SELECT doc_id, k, 3, len(m) || ' ' || j || ' ' || array_to_string(list_concat(m[1:3 + j * (len(m) - 3) // 4], m[4 + (j + 1) * (len(m) - 3) // 4:]), ' ')
  FROM f, (SELECT unnest([0, 1, 2, 3]) AS j)
  WHERE NOT numbers AND len(m) > 3 AND j * (len(m) - 3) // 4 < (j + 1) * (len(m) - 3) // 4
), o AS (
  SELECT template, min(doc_id) AS first FROM n GROUP BY template, least HAVING count(DISTINCT doc_id) >= least
), d AS (
  SELECT DISTINCT n.doc_id, n.k FROM n JOIN o ON n.template = o.template WHERE n.doc_id <> o.first
)
SELECT l.doc_id, CASE WHEN bool_and(l.line = '') AND count(*) = 1 THEN 0 ELSE count(*) END AS n_lines, count(d.k) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (d.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.k = d.k GROUP BY l.doc_id
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(measure(table(spark, sf_dir, "documents")), capacity=2048, per_source=4)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = format_conversations(turns).select(
        "conv_id", "valid", parse_formatted(F.col("formatted")).alias("ts"), loss_text(F.col("segments")).alias("loss"), F.char_length("formatted").alias("n")
    )
    spelled = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
        "valid",
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text) + 4 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', ''))
    - length(replace(text, '[', '')) - length(replace(text, '>', ''))
    + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 6
      ELSE 6 + 2 + 9 + 5 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', ''))
        - length(replace(role, '[', '')) - length(replace(role, '>', '')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM e GROUP BY conv_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, records = archive_pages(table(spark, sf_dir, "pages"))
    read = cut_lineage(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_folder(spark, folder)
    return read


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_passages(table(spark, sf_dir, "documents"), size=50)
    return left.select("doc_id", F.col("n_tokens").alias("n_words"), *_removed())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_array": op2_suffix_array,
    "op3_lines": op3_lines,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_passages": op7_passages,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
}
ORACLE_SQL: dict[str, str] = {"op3_lines": OP3_SQL, "op6_chat": OP6_SQL, "op10_warc": OP10_SQL}
