"""The queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm.docpairs import documented_functions
from custodia.llm.handwritten import unwritten_files
from custodia.llm.leakage import cleaned_documents, leaked_items
from custodia.llm.names import entity_members, name_entities, same_name_pairs
from custodia.llm.spans import shared_share, shared_spans, shared_windows
from custodia.llm.syntax import broken_files, broken_rates
from custodia.llm.tokenise import token_ids, token_offsets
from custodia.llm.topn import top_n_per_group
from custodia.session import cut
from custodia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of author rows that denote the same person or organisation."""
    return same_name_pairs(table(spark, sf_dir, "authors"), "author_id", "name", "email")


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author rows by person or organisation: one row each with the least row of the same."""
    return entity_members(table(spark, sf_dir, "authors"), "author_id", "name", "email")


def p1_commit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling in the commits with its commits and the person or organisation it denotes."""
    commits = table(spark, sf_dir, "commits").select("hash", "author_name", "author_email").distinct()
    spellings = commits.groupBy("author_name", "author_email").agg(F.count(F.lit(1)).alias("commits")).withColumn("spelling", F.xxhash64("author_name", "author_email"))
    spellings = cut(spellings)
    entities = name_entities(spellings, "spelling", "author_name", "author_email")
    return spellings.join(entities, "spelling", "left").select("author_name", "author_email", "commits", "entity")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files that are not valid in their language."""
    return broken_files(table(spark, sf_dir, "source_files"), "file_id", "file_language", "content")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of such files for each repository and language."""
    return broken_rates(table(spark, sf_dir, "source_files"), "file_id", "repo_id", "file_language", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most changed files of each author address."""
    files = table(spark, sf_dir, "changed_files").select("author_email", "file_path", "repo_id", "change_count")
    best = top_n_per_group(files, F.lower(F.trim("author_email")), "change_count", ["file_path", "repo_id"], 10)
    return best.select(F.col("group_key").alias("author_email"), "file_path", "repo_id")


P3_FOUND = """
WITH rows AS (
  SELECT DISTINCT lower(trim(author_email)) AS author_email, file_path, repo_id, change_count FROM changed_files
  WHERE author_email IS NOT NULL AND file_path IS NOT NULL AND change_count IS NOT NULL AND repo_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY author_email ORDER BY change_count DESC, file_path, repo_id) AS place FROM rows
)
SELECT author_email, file_path, repo_id FROM ranked WHERE place <= 10
"""


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files that nobody wrote by hand in their repository, each with the reasons."""
    return unwritten_files(table(spark, sf_dir, "source_files"), "file_id", "repo_id", "file_path", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source files that nobody wrote by hand in their repository."""
    return p4_reasons(spark, sf_dir).select("file_id").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions whose documentation says something, with name, parameters and documentation."""
    return documented_functions(table(spark, sf_dir, "source_files"), "file_id", "file_language", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File, line and name of these functions."""
    return p5_pairs(spark, sf_dir).select("file_id", "line_no", "name")


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_ids(documents, "doc_id", "text", f"{tokenizers}/byte_bpe_50k.tiktoken")


def p6_offsets(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The byte at which each token of every document begins."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_offsets(documents, "doc_id", "text", f"{tokenizers}/byte_bpe_50k.tiktoken").select("doc_id", "offsets")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which at least 13 consecutive words of an evaluation item stand."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "eval_items").select("item_id", "text")
    return leaked_items(documents, "doc_id", "text", items, "item_id", "text", 13).select("item_id", "doc_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without leaked passages; those of which more than half leaked are emptied."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "eval_items").select("item_id", "text")
    return cleaned_documents(documents, "doc_id", "text", items, "item_id", "text", 13)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share at least 400 consecutive code points with another one."""
    return shared_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 400).select("doc_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of at least 400 code points that stand in several documents."""
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 400)


def p8_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return shared_share(table(spark, sf_dir, "documents"), "doc_id", "text", 400)


P7_FOUND = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
doc_grams AS (SELECT doc_id, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words)),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
item_grams AS (SELECT item_id, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words))
SELECT DISTINCT item_id, doc_id FROM doc_grams JOIN item_grams USING (g)
"""

P8_FOUND = """
WITH windows AS (
  SELECT doc_id, hash(substring(text, i, 400)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)
), shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM windows JOIN shared USING (h)
"""


_P8_HITS = """
WITH windows AS (
  SELECT doc_id, i - 1 AS start, hash(substring(text, i, 400)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)
), shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, start FROM windows JOIN shared USING (h)),
marked AS (SELECT *, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 400, true)::INT AS begins FROM hits),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM marked),
spans AS (SELECT doc_id, min(start)::BIGINT AS span_start, (max(start) - min(start) + 400)::BIGINT AS span_chars FROM numbered GROUP BY doc_id, span)
"""

P8_SPANS = _P8_HITS + "SELECT doc_id, span_start, span_chars FROM spans"

P8_SHARED_SHARE = (
    _P8_HITS
    + """, sums AS (SELECT doc_id, sum(span_chars)::BIGINT AS n FROM spans GROUP BY doc_id)
SELECT doc_id, length(text)::BIGINT AS chars, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) WHEN length(text) = 0 THEN 0.0 END AS share
FROM documents LEFT JOIN sums USING (doc_id)
"""
)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_entities": p1_entities,
        "p1_commit_entities": p1_commit_entities,
        "p2_found": p2_found,
        "p2_rates": p2_rates,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_reasons": p4_reasons,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p6_ids": p6_ids,
        "p6_offsets": p6_offsets,
        "p7_found": p7_found,
        "p7_clean": p7_clean,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p8_shared_share": p8_shared_share,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_FOUND,
        "p7_found": P7_FOUND,
        "p8_found": P8_FOUND,
        "p8_spans": P8_SPANS,
        "p8_shared_share": P8_SHARED_SHARE,
    }
