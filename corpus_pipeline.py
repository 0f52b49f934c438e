"""A training corpus from `documents` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontam, language_id, mixing, ngram_join, sharding
from quillframe.llm._shared import broadcast_if_small, fresh, materialize, release, table

N_SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier accepts; it learns from the labelled ones among them."""
    model = language_id.fitted_on(docs)
    added = fresh(docs.columns, *language_id.ADDED)
    return language_id.predict_language(docs, model, added=added).filter(~F.col(added[2])).select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles link, the document with the smallest id; documents without words stay."""
    groups = materialize(ngram_join.similar_documents(docs), "groups")
    linked = groups.filter("class_key is not null")
    first = linked.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("k"))
    paired = linked.join(first, "class_key")
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("text_key").eqNullSafe(F.col("k.text_key"))
    gone_id, gone_key = fresh(docs.columns, "gone_id", "gone_key")
    gone = materialize(paired.filter(~stays).select("doc_id", "text_key").toDF(gone_id, gone_key), "gone")
    key = F.xxhash64("text")
    found = docs.join(broadcast_if_small(gone), docs["doc_id"].eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key)), "left_anti")
    twice = linked.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key").toDF(gone_id, gone_key)
    if twice.isEmpty():
        return found
    # linked rows that repeat id and text: one of them; all other rows, wordless ones among them, stay as they are
    twice = materialize(twice, "twice")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key))
    once = found.join(broadcast_if_small(twice), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return found.join(broadcast_if_small(twice), same, "left_anti").unionByName(once)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, in globally shuffled order."""
    return mixing.poisson_mix(docs, added=fresh(docs.columns, *mixing.ADDED)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.hilbert_shards(docs, ["source", "lang", "n_chars"], N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", keep_one_of_similar),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained model, similarity components and a curve through approximate quantiles have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
