"""The operators' queries over the given tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, merkle, mixing, near_dedup, piece_coding, quality_rules, sharding, suffix_dedup, token_counts, toxicity, url_filter, vector_codes
from .storage import materialize
from .words import word_count

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # the text is measured and not carried along
    measured = quality_rules.apply_rules(docs.select("doc_id", "text", "source"), carry=["doc_id"])
    return measured.select("doc_id", *quality_rules.OUTPUTS)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash")), "mix_rows")
    return mixing.mix(sized, size=F.col("words"), tie=F.col("text_hash")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, carry=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(_table(spark, sf_dir, "documents")).drop("spans")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "score", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.checksum(books)).alias("codebooks_sha256"))


def op12_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_coding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    whole = piece_coding.decode(coded)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.digest([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in columns])
    tampered = docs.withColumn("_tampered", F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed))
    made = merkle.manifest(tampered, columns, tree="lang", order="doc_id", carry=["doc_id", "_tampered"])
    done = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded(F.coalesce("_tampered", "leaf")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_near_dedup, op2_decontamination, op3_quality_rules, op4_mixing, op5_sharding, op6_suffix_dedup, op7_url_filter, op8_toxicity, op9_html_extraction, op10_token_counts, op11_vector_codes, op12_piece_coding, op13_merkle_manifest)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 4), chr(32)) AS win
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)),
starts AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 4)) AS p FROM starts) GROUP BY rid),
measured AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON c.rid = d.rid),
judged AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
         (n_symbols * 100 > word_chars * 10)::INT + (n_dup_lines * 100 > n_lines * 30)::INT + (word_chars > n_words * 20)::INT AS n_failed_soft
  FROM measured),
hosts AS (SELECT source, count(*) AS n, sum((base_failed OR n_failed_soft > 0)::INT) AS f FROM judged GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS m2, count(*) AS h, sum(n) AS n FROM hosts),
prior AS (
  SELECT m, CASE WHEN m2 - m * m - m * (1 - m) * (h - 1) / n > 0
                 THEN least(greatest(m * (1 - m) / (m2 - m * m - m * (1 - m) * (h - 1) / n) - 1, 1), 1000) ELSE 1000 END AS k
  FROM moments),
verdicts AS (
  SELECT source, CASE WHEN (f + m * k) / (n + k) > 0.5 THEN 'blocked' WHEN (f + m * k) / (n + k) > 0.05 THEN 'watch' ELSE 'ok' END AS host_verdict
  FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_soft, host_verdict,
       NOT base_failed AND n_failed_soft <= CASE host_verdict WHEN 'ok' THEN 1 WHEN 'watch' THEN 0 ELSE -1 END AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""


OP5_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t, md5(coalesce(text, '')) AS text_md5,
         CASE WHEN doc_id IS NULL THEN 'null' ELSE 'id/' || doc_id END AS key
  FROM documents),
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
checksums AS (
  SELECT rid, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::BIGINT),
         lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM docs, crc_table),
leaves AS (SELECT 'region' || (s // 4) AS region, 'rack' || (s // 2) AS rack, 'shard' || s AS leaf, s::INT AS shard FROM range(8) r(s)),
nodes AS (
  SELECT 'root' AS parent, region AS name, count(*) AS weight FROM leaves GROUP BY region
  UNION ALL SELECT region, rack, count(*) FROM leaves GROUP BY region, rack
  UNION ALL SELECT rack, leaf, 1 FROM leaves
  UNION ALL SELECT 'grown', 'region-8', 1),
draws AS (
  SELECT key, parent, name, -ln((('0x' || substr(md5(key || '/' || name), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / weight AS d
  FROM (SELECT DISTINCT key FROM docs), nodes),
won AS (SELECT key, parent, arg_min(name, d) AS name, min(d) AS d FROM draws GROUP BY key, parent),
placed AS (
  SELECT a.key, l.shard, CASE WHEN g.d < a.d THEN 8 ELSE l.shard END::INT AS grown_shard
  FROM won a JOIN won b ON b.key = a.key AND b.parent = a.name JOIN won c ON c.key = a.key AND c.parent = b.name
       JOIN leaves l ON l.leaf = c.name JOIN won g ON g.key = a.key AND g.parent = 'grown'
  WHERE a.parent = 'root')
SELECT doc_id, (octet_length(t) + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || '/' || text_md5), key) - 1 AS slot, grown_shard
FROM docs JOIN checksums USING (rid) JOIN placed USING (key)
"""


# k-means of 8 parts and 16 entries in 6 rounds, written out round by round
_OP11_ROUND = """
near{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
  FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN books{r} b ON b.part = p.part)
  GROUP BY vec_id, label, part, x),"""
_OP11_BOOKS = """
sums{r} AS (
  SELECT part, entry, i, sum(v)::BIGINT AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY part, entry, i),
means{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{r} GROUP BY part, entry),
books{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM books{r} b LEFT JOIN means{r} m USING (part, entry)),"""

OP11_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 4096)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, x[part * len(x) // 8 + 1 : (part + 1) * len(x) // 8] AS x FROM kept, (SELECT unnest(range(8)) AS part)),
books0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),"""
    + "".join(_OP11_ROUND.format(r=r) + _OP11_BOOKS.format(r=r, next=r + 1) for r in range(6))
    + _OP11_ROUND.format(r=6)
    + """
rows AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM books6) AS codebooks_sha256
FROM rows
"""
)

OP13_SQL = r"""
WITH RECURSIVE docs AS (SELECT *, coalesce('=' || lang, '') AS tree FROM documents),
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
fields AS (
  SELECT doc_id, tree, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295) % 7 = 0 AS tampered
  FROM docs, crc_table),
leaves AS MATERIALIZED (
  SELECT doc_id, tree, tampered, head, tail, n_chars, leaf,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size
  FROM (SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf FROM fields)),
below AS (
  SELECT tree, 0 AS level, place, size, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM below WHERE size > 1 GROUP BY tree, level, place // 2, size),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS tree_at, count(*) OVER () AS trees FROM below WHERE size = 1),
above AS (
  SELECT 0 AS level, tree_at AS place, trees AS size, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM above WHERE size > 1 GROUP BY level, place // 2, size),
nodes AS MATERIALIZED (
  SELECT tree, level, place, size, digest FROM below UNION ALL SELECT '/', level, place, size, digest FROM above),
climbed AS (
  SELECT l.tree, l.place AS leaf_at, l.tree AS inside, 0 AS level, l.place, l.size, '' AS proof,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) ELSE leaf END AS digest
  FROM leaves l
  UNION ALL
  SELECT c.tree, leaf_at, CASE WHEN c.size > 1 THEN inside ELSE '/' END, CASE WHEN c.size > 1 THEN c.level + 1 ELSE 0 END,
         CASE WHEN c.size > 1 THEN c.place // 2 ELSE s.tree_at END, CASE WHEN c.size > 1 THEN (c.size + 1) // 2 ELSE s.trees END,
         CASE WHEN c.size > 1 THEN proof || coalesce(n.digest, '') ELSE proof END,
         CASE WHEN c.size = 1 THEN c.digest WHEN c.place % 2 = 1 THEN sha256(n.digest || c.digest) ELSE sha256(c.digest || coalesce(n.digest, '')) END
  FROM climbed c JOIN subroots s ON s.tree = c.tree
       LEFT JOIN nodes n ON n.tree = c.inside AND n.level = c.level AND n.place = xor(c.place, 1) AND c.size > 1
  WHERE c.size > 1 OR c.inside <> '/')
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = r.digest AS verified
FROM climbed c JOIN leaves l ON l.tree = c.tree AND l.place = c.leaf_at JOIN subroots s ON s.tree = c.tree, (SELECT digest FROM above WHERE size = 1) r
WHERE c.inside = '/' AND c.size = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op5_sharding": OP5_SQL, "op11_vector_codes": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
