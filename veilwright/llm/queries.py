"""Registered queries of the training-data operators: the digest columns of their contracts, from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.sources.scratch import scratch_path, written

from . import (
    alignment,
    chat,
    collocations,
    compression_quality,
    packing,
    quality_rules,
    sentencepieces,
    simhash,
    sitetree,
    substrings,
    topk,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark, sf_dir):
    """Number and CRC-32 of the ids of every text, and the SHA-256 of the text decoded from them."""
    model = public_tokenizer("piece_bpe_32k.model")
    decoded = sentencepieces.encode(load(spark, sf_dir, "documents"), model, with_text=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                          F.sha2("text", 256).alias("decoded_sha256"))


@query
def op2_substring_dedup(spark, sf_dir):
    out = substrings.dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_sub_n_words").alias("n_words"), F.col("_sub_n_removed").alias("n_removed"),
                      F.sha2("_sub_kept", 256).alias("kept_sha256"))


# Windows as lists of 50 words; the first document of each decides.
ORACLES["op2_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS win
  FROM d, unnest(CASE WHEN len(words) >= 50 THEN range(1, len(words) - 48) ELSE [] END) AS t(i)),
first_doc AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, i + k AS place
  FROM w JOIN first_doc USING (win), unnest(range(0, 50)) AS s(k) WHERE low < doc_id),
per_doc AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words
    ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN per_doc USING (doc_id)
"""


@query
def op3_warc_revisits(spark, sf_dir):
    archive = scratch_path(spark, "warc")
    warc.write_archive(warc.page_records(load(spark, sf_dir, "pages")), archive)
    return warc.page_results(warc.read_archive(spark, archive))


# Base 32: five hexadecimal digits are four letters.
ORACLES["op3_warc_revisits"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hash FROM pages),
f AS (SELECT hash, min(page_id) AS low FROM p GROUP BY hash)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(p.hash, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM p JOIN f ON p.hash = f.hash
"""


@query
def op4_maxscore(spark, sf_dir):
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_maxscore"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.place <> c.place)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op5_simhash_golay(spark, sf_dir):
    near = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_chat_snapshots(spark, sf_dir):
    """Every rendered turn of the conversations that no longer one begins with."""
    return chat.rendered_turns(load(spark, sf_dir, "conversations"))


ORACLES["op6_chat_snapshots"] = """
WITH t AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS BIGINT) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
c AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    list(md5(CAST(length(role) AS VARCHAR) || ':' || role || text) ORDER BY place) AS turns
  FROM t GROUP BY conv_id),
alike AS (SELECT turns, n_turns, min(conv_id) AS conv_id FROM c GROUP BY ALL),
begun AS (
  SELECT DISTINCT turns[1:k] AS turns FROM c, unnest(range(1, n_turns)) AS u(k)),
kept AS (SELECT conv_id, n_turns FROM alike WHERE turns NOT IN (SELECT turns FROM begun))
SELECT t.conv_id, place, n_turns,
  '<|im_start|>' || replace(replace(role, '<|im_start|>', '<|im_start_|>'), '<|im_end|>', '<|im_end_|>') || chr(10)
    || replace(replace(text, '<|im_start|>', '<|im_start_|>'), '<|im_end|>', '<|im_end_|>') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
"""


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op8_compression_quality(spark, sf_dir):
    return compression_quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op9_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept")


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


@query
def op12_son_collocations(spark, sf_dir):
    return collocations.collocations(load(spark, sf_dir, "documents"))


# Every phrase of every piece, counted; whole numbers of 128 bits for the products.
ORACLES["op12_son_collocations"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM documents, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS u(p)),
f AS (
  SELECT lang, k, words[i:i + k - 1] AS words, count(*) AS a
  FROM piece, unnest([1, 2, 3, 4]) AS s(k), unnest(range(1, len(words) - k + 2)) AS t(i)
  GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
cut AS (
  SELECT c.lang, c.k, c.words, c.a, x.a AS l, y.a AS r, place,
    CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM c, unnest(range(1, c.k)) AS s(place)
  JOIN f AS x ON x.lang = c.lang AND x.words = c.words[1:place]
  JOIN f AS y ON y.lang = c.lang AND y.words = c.words[place + 1:c.k]),
worst AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, place) = 1),
around AS (
  SELECT lang, words[i:i + m - 1] AS words, max(a) AS most
  FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
ranked AS (
  SELECT w.lang, array_to_string(w.words, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, array_to_string(w.words, ' ')) AS rank
  FROM worst AS w LEFT JOIN around USING (lang, words)
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op13_cross_tokenizer_alignment(spark, sf_dir):
    sides = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
    aligned = alignment.align(load(spark, sf_dir, "documents"), *sides)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    # What the query needs of the groups is stored, not the groups: they are some three times as long as the texts.
    stored = written(aligned.select("doc_id", "n_a", "n_b", digest.alias("groups_sha256"), "links"), "aligned")
    return alignment.with_counts(stored, *sides).select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op11_site_style_tree(spark, sf_dir):
    return sitetree.main_text(load(spark, sf_dir, "pages"))
