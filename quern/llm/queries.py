"""The registered queries of the training-data operators, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, chat, decontaminate, html_text, line_dedup, quality, simhash, spotsigs, substring_dedup, toxicity
from quern.llm.common import read, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), digests=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(read(spark, sf_dir, "conversations"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir), digests=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(read(spark, sf_dir, "pages"), "page_id"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), digests=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_document_fingerprints, op4_chat_formatting, op5_substring_dedup, op6_html_extraction, op7_bpe, op8_quality, op9_simhash, op10_decontamination)}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op4_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER w AS prefix,
             string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS name
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT conv_id, max(n) AS n FROM p GROUP BY conv_id),
full_ AS (SELECT p.conv_id, p.n, p.prefix, p.name FROM p JOIN whole ON p.conv_id = whole.conv_id AND p.n = whole.n),
inner_ AS (SELECT DISTINCT p.name FROM p JOIN whole ON p.conv_id = whole.conv_id AND p.n < whole.n)
SELECT min(conv_id) AS conv_id, min(n) AS n_turns, min(prefix) AS rendered FROM full_
WHERE name NOT IN (SELECT name FROM inner_) GROUP BY name""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS pos FROM d WHERE len(ws) >= 35),
w AS (SELECT r, pos, md5(array_to_string(ws[pos:pos + 34], ' ')) AS h FROM p),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(pos, pos + 35)) AS pos FROM w JOIN c ON w.h = c.h),
i AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
s AS (SELECT i.r, count(*) AS n_words, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY i.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM i LEFT JOIN g ON i.r = g.r AND i.pos = g.pos GROUP BY i.r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r""",
    "op10_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS pos FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(ws[pos:pos + 9], ' ') AS s, least(len(ws), 10) AS k FROM v),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos FROM d, ks WHERE len(ws) >= k),
o AS (SELECT p.r, p.pos, p.k, win.item_id FROM p JOIN win ON win.k = p.k AND win.s = array_to_string(p.ws[p.pos:p.pos + p.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS x FROM o) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN n ON d.r = n.r""",
}
