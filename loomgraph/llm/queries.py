"""The queries of this subpackage's operators over the test tables, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, language_id, line_dedup, media, mixing, near_dup, suffix_dedup, token_ids, toxicity, url_lists
from loomgraph.llm.common import saved, shown_id, table
from loomgraph.shipping import shipped


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@shipped
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = token_ids.token_ids(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return rows


@shipped
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


@shipped
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.owner <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE r.owner IS NULL OR r.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""


@shipped
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@shipped
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


@shipped
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@shipped
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents; containers in other classes for those of documents whose id 20 divides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dup.with_containers(docs, saved(near_dup.classes(docs), "classes"))
    return found.select(shown_id("doc").alias("doc_id"), shown_id("class_doc").alias("class_id"), "n_shingles", "n_containers", shown_id("container_doc").alias("container_id"))


@shipped
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(saved(media.store(table(spark, sf_dir, "documents")), "media"))


@shipped
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(shown_id("doc").alias("doc_id"), "item_id", "score", "matches", "first_word", "last_word")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_ids, op2_toxicity, url_lists.op3_url_lists, op4_line_dedup, op5_mixing, op6_language_id, op7_suffix_dedup, op8_near_dup, op9_media, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_lists": url_lists.OP3_SQL, "op4_line_dedup": OP4_SQL}
