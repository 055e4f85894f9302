"""The thin queries over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.llm import alignment, chat, decontaminate, fingerprint, interpolated_lm, jaccard_join, linediff, mixing, quality, toxicity, warc, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "similarity")


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linediff.dedup_lines(docs).select("doc_id", "removed_lines", "removed_words", "text")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    digest = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload"))
    return warc.round_trip(pages).select(
        "page_id", F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(rows))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS o
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rk FROM s0),
s2 AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
              source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS fills_at FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / sum(w) OVER r AS lvl
       FROM s3 WINDOW b AS (ORDER BY fills_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      r AS (ORDER BY fills_at, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT arg_min(lvl, (fills_at, rk)) AS lvl FROM s4 WHERE lvl <= fills_at),
s5 AS (SELECT source, rk, source_size, CASE WHEN h.lvl IS NULL THEN cap ELSE least(cap, h.lvl * w) END AS target FROM s4 LEFT JOIN h ON true),
s6 AS (SELECT *, round(target)::BIGINT AS words FROM s5),
s7 AS (SELECT *, sum(words) OVER (ORDER BY rk)::BIGINT AS upto, sum(words) OVER ()::BIGINT AS total FROM s6),
s8 AS (SELECT *, (upto - words) / total::DOUBLE AS lo, upto / total::DOUBLE AS hi, greatest(1, (total + 4095) // 4096) AS n FROM s7),
slots AS (SELECT i, i * 1327217885 % 2147483648 / 2147483648::DOUBLE AS u FROM (SELECT unnest(range((SELECT any_value(n) FROM s8))) AS i)),
d0 AS (SELECT s8.rk, i FROM slots JOIN s8 ON u >= lo AND u < hi AND words > 0),
d1 AS (SELECT rk, i FROM d0 UNION ALL
       SELECT rk, least(n - 1, floor((lo + hi) / 2 * n)::BIGINT) FROM s8 WHERE words > 0 AND rk NOT IN (SELECT rk FROM d0)),
turns AS (SELECT rk, i, row_number() OVER (PARTITION BY rk ORDER BY i) - 1 AS turn FROM d1),
s9 AS (SELECT s8.*, words // t AS b, words % t AS odd FROM s8 LEFT JOIN (SELECT rk, count(*) AS t FROM turns GROUP BY 1) USING (rk)),
ends AS (SELECT rk, i, turn, turn * b + least(turn, odd) AS lo_word, (turn + 1) * b + least(turn + 1, odd) AS hi_word FROM turns JOIN s9 USING (rk)),
p AS (SELECT d.*, s9.rk, s9.words, s9.b, s9.odd, s9.source_size, s9.target, row_number() OVER () AS rid,
             coalesce(sum(size) OVER (PARTITION BY s9.rk ORDER BY o, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN s9 ON d.source IS NOT DISTINCT FROM s9.source),
q AS (SELECT *, unnest(range((words - 1) // source_size + 1)) * source_size + pos AS x0 FROM p WHERE size > 0 AND words > 0),
r AS (SELECT *, least(x0 + size, words) AS x1 FROM q WHERE x0 < words),
e AS (SELECT rid, rk, x0, x1, unnest(range(
        CASE WHEN x0 < odd * (b + 1) THEN x0 // (b + 1) ELSE odd + (x0 - odd * (b + 1)) // greatest(b, 1) END,
        CASE WHEN x1 - 1 < odd * (b + 1) THEN (x1 - 1) // (b + 1) ELSE odd + (x1 - 1 - odd * (b + 1)) // greatest(b, 1) END + 1)) AS turn FROM r),
t AS (SELECT rid, sum(least(x1, hi_word) - greatest(x0, lo_word))::BIGINT AS taken, min(i) AS first_slot FROM e JOIN ends USING (rk, turn) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM p LEFT JOIN t USING (rid)
"""

OP2_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+') AS w FROM benchmark),
it AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
ish AS (SELECT item_id, n, k, o, array_to_string(list_slice(w, o, o + k - 1), ' ') AS s
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS o FROM it)),
ks AS (SELECT DISTINCT k FROM it),
dsh AS (SELECT doc_id, k, i, len(w) AS m, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
met0 AS (SELECT DISTINCT d.doc_id, h.n, h.k, d.i, d.m FROM dsh d JOIN ish h ON d.k = h.k AND d.s = h.s),
hit AS (SELECT DISTINCT doc_id, n, k, unnest(range(greatest(0, least(i - 1 - (n - k), m - n)), greatest(0, least(i - 1, m - n)) + 1)) AS start FROM met0),
ours AS (SELECT h.doc_id, h.n, h.k, h.start, d.s, count(*) AS c
         FROM hit h JOIN dsh d ON d.doc_id = h.doc_id AND d.k = h.k AND d.i > h.start AND d.i <= h.start + h.n - h.k + 1
         GROUP BY 1, 2, 3, 4, 5),
size AS (SELECT doc_id, n, k, start, sum(c) AS total FROM ours GROUP BY 1, 2, 3, 4),
theirs AS (SELECT item_id, n, k, s, count(*) AS c FROM ish GROUP BY 1, 2, 3, 4),
met AS (SELECT o.doc_id, t.item_id, o.start, o.n, o.k, sum(least(o.c, t.c)) AS shared
         FROM ours o JOIN theirs t ON o.n = t.n AND o.k = t.k AND o.s = t.s GROUP BY 1, 2, 3, 4, 5),
sim AS (SELECT b.doc_id, b.item_id, b.start, b.n, b.shared, z.total + (b.n - b.k + 1) - b.shared AS whole
        FROM met b JOIN size z ON z.doc_id = b.doc_id AND z.n = b.n AND z.k = b.k AND z.start = b.start),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared::DOUBLE / whole DESC, start DESC) AS r
         FROM sim WHERE 100 * shared >= 80 * whole)
SELECT doc_id, item_id, start::BIGINT AS start, n::BIGINT AS n_words, shared::DOUBLE / whole::DOUBLE AS similarity FROM best WHERE r = 1
"""

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h,
             row_number() OVER (PARTITION BY sha1(b), octet_length(b) ORDER BY page_id DESC NULLS LAST) AS r FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM q)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND r > 1 THEN keeper END AS refers_to
FROM k
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
             ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def queries() -> dict:
    return {"op1_mix_sources": op1_mix_sources, "op2_decontaminate": op2_decontaminate, "op3_interpolated_lm": op3_interpolated_lm, "op4_line_dedup": op4_line_dedup, "op5_fingerprint": op5_fingerprint, "op6_html_text": op6_html_text, "op7_warc": op7_warc, "op8_jaccard_join": op8_jaccard_join, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality, "op11_chat_format": op11_chat_format, "op12_token_alignment": op12_token_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_decontaminate": OP2_SQL, "op7_warc": OP7_SQL, "op8_jaccard_join": OP8_SQL}
