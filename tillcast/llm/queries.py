"""The queries of these operators over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.audit import audit_filters
from tillcast.llm.backtracking import decode_ids, encode_texts
from tillcast.llm.bpe import encode_and_decode
from tillcast.llm.caps import linked_vectors
from tillcast.llm.common import utf8, workspace
from tillcast.llm.html_text import extract_text
from tillcast.llm.lines import dedup_lines
from tillcast.llm.maxent import score_texts
from tillcast.llm.merkle import folded, manifest, siblings
from tillcast.llm.minhash import near_copies
from tillcast.llm.packing import pack_documents
from tillcast.llm.quality import fit_quality_model, score_quality
from tillcast.llm.sharding import shard_by_bytes
from tillcast.llm.warc import read_archive, write_archive


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_by_bytes(table(spark, folder, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = fit_quality_model(docs.join(labels, "doc_id"))
    return score_quality(docs, model)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = workspace(spark, "warc")
    pages = table(spark, folder, "pages")
    write_archive(pages.select(F.col("page_id").alias("record_id"), "url", utf8("html").alias("payload")), path)
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


OP1_SQL = """
WITH records AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), digests AS (
  SELECT page_id, first_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM records
), fives AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts
  FROM digests
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda shift: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> shift) & 31) + 1, 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM fives
"""


def op2_maxent(spark: SparkSession, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = table(spark, folder, "documents")
    return score_texts(docs.select("doc_id", (fold == 2).alias("held_out"), "text"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"))


OP3_SQL = r"""
WITH RECURSIVE heard AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 5
      THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle
  FROM heard
), sizes AS (
  SELECT doc_id, count(shingle) AS n_shingles FROM documents LEFT JOIN shingles USING (doc_id)
  GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * n >= 75 * (x.n_shingles + y.n_shingles - n)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.node = links.a
)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(node) AS component_id,
       doc_id = min(node) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op4_caps(spark: SparkSession, folder: str) -> DataFrame:
    return linked_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(
        table(spark, folder, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op8_lines(spark: SparkSession, folder: str) -> DataFrame:
    deduped = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return deduped.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT doc_id, pos, line, coalesce(owner <> doc_id, false) AS dropped
  FROM lines LEFT JOIN owners USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), ''))
         AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op11_backtracking(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_texts(table(spark, folder, "documents").select("doc_id", "text"), path, packed=True)
    return decode_ids(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(first_id < texts.doc_id, false)] AS fails
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
), kinds AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL
), numbers AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS n
), orders AS (
  SELECT [a.n, b.n, c.n, d.n, e.n] AS filters
  FROM numbers a, numbers b, numbers c, numbers d, numbers e
  WHERE len(list_distinct([a.n, b.n, c.n, d.n, e.n])) = 5
), steps AS (
  SELECT array_to_string(list_transform(filters, lambda f: substr('ABCDE', f, 1)), '') AS filter_order,
         numbers.n AS step, filters[numbers.n] AS filter, filters[:numbers.n - 1] AS before,
         list_filter([1, 2, 3, 4, 5], lambda f: f <> filters[numbers.n]) AS others
  FROM orders, numbers
), met AS (
  SELECT part, filter_order, step, filter, good, toxic, n, fails[filter] AS here,
         len(list_filter(before, lambda f: fails[f])) > 0 AS gone,
         len(list_filter(others, lambda f: fails[f])) = 0 AS alone
  FROM steps, kinds
), counted AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND here), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND here), 0) AS redundant,
         coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND here AND good = 1), 0) AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND here AND toxic = 1), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(table(spark, folder, "documents"), tampered)
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("shown"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE fields AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda digit: CAST(ascii(digit) AS BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, zero: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail)
         END AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 2
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS lvl, place, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY place))
  FROM upper_nodes WHERE n > 1 GROUP BY lvl, place // 2
), steps AS (
  SELECT doc_id, leaf, changed, placed.tree, placed.place, lvl, (placed.place >> lvl) & 1 AS side,
         any_value(digest) FILTER (nodes.place = xor(placed.place >> lvl, 1)) AS sibling
  FROM placed JOIN nodes ON nodes.tree = placed.tree AND nodes.n > 1
    AND nodes.place IN (placed.place >> lvl, xor(placed.place >> lvl, 1))
  GROUP BY ALL
  UNION ALL
  SELECT doc_id, leaf, changed, placed.tree, placed.place, 100 + lvl, (subroots.place >> lvl) & 1,
         any_value(upper_nodes.digest) FILTER (upper_nodes.place = xor(subroots.place >> lvl, 1))
  FROM placed JOIN subroots ON subroots.tree = placed.tree JOIN upper_nodes ON upper_nodes.n > 1
    AND upper_nodes.place IN (subroots.place >> lvl, xor(subroots.place >> lvl, 1))
  GROUP BY ALL
), proofs AS (
  SELECT tree, place, string_agg(sibling, '' ORDER BY lvl) AS proof,
         list_reduce([any_value(coalesce(changed, leaf))] || list(side || coalesce(sibling, '') ORDER BY lvl),
           lambda digest, step: sha256(CASE WHEN step[1] = '1' THEN step[2:] || digest ELSE digest || step[2:] END))
           AS folded
  FROM steps GROUP BY tree, place
)
SELECT doc_id, leaf, subroots.digest AS subroot, top.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       coalesce(folded, changed, leaf) AS folded_root, coalesce(folded, changed, leaf) = top.digest AS verified
FROM placed JOIN subroots USING (tree) JOIN upper_nodes top ON top.n = 1
LEFT JOIN proofs ON proofs.tree = placed.tree AND proofs.place = placed.place
"""


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_maxent": op2_maxent,
        "op3_minhash": op3_minhash,
        "op4_caps": op4_caps,
        "op5_packing": op5_packing,
        "op6_html": op6_html,
        "op7_bpe": op7_bpe,
        "op8_lines": op8_lines,
        "op9_sharding": op9_sharding,
        "op10_quality": op10_quality,
        "op11_backtracking": op11_backtracking,
        "op12_audit": op12_audit,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op3_minhash": OP3_SQL,
        "op8_lines": OP8_SQL,
        "op12_audit": OP12_SQL,
        "op13_merkle": OP13_SQL,
    }
