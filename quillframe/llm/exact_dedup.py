"""Exact deduplication by skew-safe combining.

Three stages, each grouping on the digest *and* the whole normalised text, so
that two texts only ever meet in a group when they are identical:

1. local: the map-side half of the first aggregate merges equal texts in a task
   before anything moves;
2. salted: what is left moves to (digest, salt), so a group that holds a third
   of all rows is spread over `salts` tasks;
3. global: at most `salts` winners of a text meet by digest.

Rows then find their group over narrow columns, by (digest, salt). Where two
different texts share a digest, which stage 3 sees since it compares texts,
the rows of that digest are matched on their text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", salts=64, digest=sha256_digest) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_digest.

    Null texts count as empty and form one group with empty ones. Of equal texts
    the smallest id stays; rows that repeat an id with equal text count each in
    group_size and one of them alone is kept. A null id sorts last: it is kept
    only where its whole group has none. An empty table gives an empty result.
    Other columns of docs are ignored. digest is any function of the normalised
    text; a poor one costs time, not correctness.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    keyed = base.withColumns({"_digest": digest(F.col("_text")), "_salt": F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")})
    salted = keyed.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    whole = salted.groupBy("_digest", "_text").agg(F.min("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_salts"))
    groups = whole.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"),
        F.first("keep_id").alias("keep_id"),
        F.first("group_size").alias("group_size"),
        F.first("_salts").alias("_salts"),
    )
    groups = materialize(groups, "exact-groups")
    rows = keyed.select("_id", "_digest", "_salt")
    alone = groups.filter("_texts = 1").select("_digest", "keep_id", "group_size", F.explode("_salts").alias("_salt"))
    columns = ["_id", "keep_id", "group_size", "_digest", "_salt"]
    found = rows.join(alone, ["_digest", "_salt"]).select(*columns)
    mixed = groups.filter("_texts > 1").select("_digest")
    if not mixed.isEmpty():
        texts = keyed.join(mixed, "_digest", "left_semi")
        winners = whole.join(mixed, "_digest", "left_semi").select("_digest", "_text", "keep_id", "group_size", F.explode("_salts").alias("_salt"))
        found = found.unionByName(texts.join(winners, ["_digest", "_text", "_salt"]).select(*columns))
    # rows that repeat the winning id: the first of them stays; they share a salt, so the join's partitioning serves
    again = F.row_number().over(Window.partitionBy("_digest", "_salt", "_id", "keep_id").orderBy("group_size"))
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"),
        F.col("_digest").alias("text_digest"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("text_digest", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
