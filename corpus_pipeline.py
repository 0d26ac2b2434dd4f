"""A corpus pipeline of five stages; each takes and returns documents, and is written and reread between.

Toxic documents go; of each class of near duplicates one document stays; copies of benchmark items go; sources are mixed
to their target weights (documents may repeat); the mixture becomes token id shards with their index.

Cases, for every stage but the last: all columns of its documents come out, whatever they are named (save for the few names
that begin with two underscores, which the operators use); null and empty texts are neither toxic nor copies of anything, and of
size 0 in the mixture, so they stay; rows that share a doc_id are told apart by text; equal rows are one document to near
duplicates, of which one stays (those without a shingle all stay); very long texts are read whole, each in one task; ties go
to the smaller document or hash, as each operator says; empty documents, labels or items give an empty result or leave all as it is. The last
stage gives a row for each document of the mixture, found by its key; a null doc_id is a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, mixing, near_dup, token_ids, toxicity
from loomgraph.llm.common import saved, table
from loomgraph.llm.queries import tokenizer_path
from loomgraph.shipping import shipped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Under names that the results don't have.
    held = {c: f"__column{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    judged = toxicity.toxicity(docs.withColumnsRenamed(held), table(spark, sf_dir, "labels"))
    return judged.where("not rejected").select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = token_ids.token_ids(spark, docs, tokenizer_path())
    return rows


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", shipped(drop_toxic)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("decontamination", shipped(drop_contaminated)),
    ("mixing", shipped(mix_sources)),
    ("token_ids", shipped(write_token_ids)),
]
#: No stage's model, sketch or codec is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
