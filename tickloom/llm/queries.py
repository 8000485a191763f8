"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language_id, licenses, line_dedup, ngram_join, prefix_trie, quality_model, quality_rules, toxicity, vector_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without later copies of equal and near lines."""
    out = line_dedup.dedup_lines(_documents(spark, folder))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.quality_rules(_documents(spark, folder))


@query
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document: four-word shingles, similarity 0.85."""
    return ngram_join.ngram_join(_documents(spark, folder), 4, 85)


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    return bpe.encode(_documents(spark, folder), tokenizer(), with_ids=False)


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.license_scan(_documents(spark, folder))


ORACLES["op8_license_scan"] = licenses.license_sql()


@query
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that quotes the control strings, formatted and read back."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoted = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document; a fifth is held out of training."""
    return language_id.language_id(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"))


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document; a third of the labels is held out."""
    return quality_model.quality(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document; a fifth of the labels is held out."""
    return toxicity.toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the evidence."""
    found = decontaminate.matches(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("lcs_share", 4).alias("lcs_share"), F.round("answer_share", 4).alias("answer_share"), "first_word")


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All prefixes of the conversations, which share heads of up to five turns by hundreds."""
    turns = prefix_trie.turns_of(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns))


# crc32 by table: entry i is i after eight steps of the reflected polynomial
ORACLES["op11_conversation_trie"] = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)
),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1])), 4294967295) % 6 AS h
  FROM ids, crc_table
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) - 1 AS k, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
),
rebuilt AS (
  SELECT h.conv_id, t.k, 0 AS part, t.r, t.x FROM heads h JOIN turns t ON t.conv_id = h.base AND t.k < h.h
  UNION ALL SELECT h.conv_id, t.k, 1, t.r, t.x FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k >= h.h
),
seqs AS (
  SELECT h.conv_id, coalesce(q.s, []) AS s
  FROM heads h LEFT JOIN (SELECT conv_id, list({'r': r, 'x': x} ORDER BY part, k) AS s FROM rebuilt GROUP BY conv_id) q ON q.conv_id = h.conv_id
),
prefixes AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM seqs),
keyed AS (SELECT conv_id, depth, CAST(s[1:depth] AS VARCHAR) || '#' || depth AS key, len(s) = depth AS whole,
  CASE WHEN depth > 0 THEN CAST(s[1:depth - 1] AS VARCHAR) || '#' || (depth - 1) END AS up, CASE WHEN depth > 0 THEN length(s[depth].x) ELSE 0 END AS chars FROM prefixes),
nodes AS (
  SELECT key, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256
  FROM keyed GROUP BY key
),
family AS (SELECT up AS key, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN family f ON f.key = n.key),
below AS (
  SELECT a.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM counted n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.key = n.key LEFT JOIN nodes p ON p.key = n.up
"""


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened coordinates of all vectors on the 32 leading components."""
    out = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of near-duplicate vectors of one label: cosine 0.93."""
    return vector_dedup.vector_dedup(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLES["op13_embedding_neardup"] = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS node, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.node AS u, b.node AS v FROM usable a JOIN usable b ON a.label = b.label AND a.node <> b.node AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
numbers AS (SELECT u, count(*) AS n FROM links GROUP BY u),
least AS (SELECT r.u, min(x.vec_id) AS m FROM reach r JOIN usable x ON x.node = r.v GROUP BY r.u),
found AS (
  SELECT x.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(m.m, x.vec_id), x.vec_id) AS component_id
  FROM usable x LEFT JOIN numbers n ON n.u = x.node LEFT JOIN least m ON m.u = x.node
)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM found
UNION ALL
SELECT vec_id, 0, vec_id, TRUE FROM embeddings
WHERE label IS NULL OR embedding IS NULL OR len(embedding) = 0 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0
"""
