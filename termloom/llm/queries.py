"""The queries opN_<name> on the generated tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import interleave, langid, lempelziv, mixing, packing, runlength, sharding, simhash, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archive(_read(spark, sf_dir, "pages")))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (
  SELECT *, sha1(html) AS s FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - i % 4 * 5)::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = interleave.store(_read(spark, sf_dir, "documents"))
    parsed = interleave.parse(stored.select("doc_id", "n_bytes", "html"))
    resolved = interleave.resolve(parsed, interleave.describe(stored)).where("kind = 'media'")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return resolved.select(*names, F.col("pos").alias("position"), "caption")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS ws,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s
), c AS (
  SELECT *, 3 * source_size * (ws - w_before) < w * (t - full_before) AS capped FROM o
), f AS (
  SELECT max(t) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS rest, coalesce(sum(w) FILTER (NOT capped), 0) AS free FROM c
), g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * rest)::BIGINT::DOUBLE / greatest(free, 1)::DOUBLE END AS target FROM c, f
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || d.key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength.deduplicate(_read(spark, sf_dir, "documents"), window=200)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP7_SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, text, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
    CASE WHEN text IS NULL THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT END AS text_crc32
  FROM documents, tbl
), g0 AS (
  SELECT text, sum(size)::BIGINT AS gsize, min(doc_id) AS first FROM d GROUP BY text
), g AS (
  SELECT text, gsize, sum(gsize) OVER (ORDER BY first NULLS FIRST, coalesce(sha256(text), ''))::BIGINT AS upto FROM g0
), b AS (
  SELECT max(upto) AS total, greatest(max(gsize), (max(upto) + 39) // 40) AS lo, greatest(max(gsize), (max(upto) + 39) // 40) + max(gsize) AS hi FROM g
), search(lo, hi, k, pos) AS (
  SELECT lo, hi, 0, 0::BIGINT FROM b
  UNION ALL
  SELECT CASE WHEN nxt < total AND k = 39 THEN mid + 1 ELSE lo END, CASE WHEN nxt = total THEN mid ELSE hi END,
    CASE WHEN nxt = total OR k = 39 THEN 0 ELSE k + 1 END, CASE WHEN nxt = total OR k = 39 THEN 0 ELSE nxt END
  FROM (SELECT s.lo, s.hi, s.k, (s.lo + s.hi) // 2 AS mid, b.total, (SELECT coalesce(max(upto), 0) FROM g WHERE g.upto <= s.pos + (s.lo + s.hi) // 2) AS nxt FROM search s, b WHERE s.lo < s.hi) q
), best AS (
  SELECT max(lo) AS capacity FROM search WHERE lo = hi
), cuts(k, pos) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT c.k + 1, (SELECT max(upto) FROM g, best WHERE g.upto <= c.pos + capacity) FROM cuts c, b WHERE c.pos < b.total AND c.k < 40
), placed AS (
  SELECT d.doc_id, d.size, d.text_crc32, g.upto, (SELECT count(*) FROM cuts WHERE k > 0 AND pos < g.upto)::INTEGER AS shard FROM d JOIN g ON d.text IS NOT DISTINCT FROM g.text
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.deduplicate(_read(spark, sf_dir, "documents"), window=35)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS pos, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35
), r AS (
  SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), m AS (
  SELECT u.doc_id, u.pos, word, max(CASE WHEN r.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.doc_id ORDER BY u.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.pos = u.pos
), a AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_interleave": op3_interleave,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_suffix": op6_suffix,
    "op7_sharding": op7_sharding,
    "op8_substring": op8_substring,
    "op9_topk": op9_topk,
    "op10_packing": op10_packing,
}
SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op5_mixing": OP5_SQL, "op7_sharding": OP7_SQL, "op8_substring": OP8_SQL, "op9_topk": OP9_SQL}
