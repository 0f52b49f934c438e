"""Pairing, first-wins deduplication and sampling of file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stem(path: str):
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*names), F.col(order)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in names])


def pair_candidates(left: DataFrame, right: DataFrame, *, key: str = "stem", order: str = "path", prefix: str = "") -> DataFrame:
    """Rows of both sides that share a key with the prefix: key, left_<order>, right_<order>; the first of each side counts."""
    one = first_per(left.filter(F.startswith(key, F.lit(prefix))), key, order).select(key, F.col(order).alias(f"left_{order}"))
    two = first_per(right.filter(F.startswith(key, F.lit(prefix))), key, order).select(key, F.col(order).alias(f"right_{order}"))
    return one.join(two, key)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the same ones however df is partitioned; an error if there are fewer."""
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    have = df.count()
    if have < n:
        raise ValueError(f"{n} rows asked for, {have} there")
    return seeded_order(df, seed, key).limit(n)


def seeded_order(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)


def archive_names(df: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """df with `target`: name, or name with _1, _2 ... before its suffix for later rows of the same name."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
    base, suffix = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return ranked.withColumn("target", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), F.col("_n").cast("string"), suffix))).drop("_n")


def ordered_distinct(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of first, then of second, each once: key, side (0 or 1), ord (smallest of its side)."""
    both = first.select(key, F.lit(0).alias("side"), "ord").unionByName(second.select(key, F.lit(1).alias("side"), "ord"))
    return both.groupBy(key).agg(F.min(F.struct("side", "ord")).alias("_at")).select(key, "_at.side", "_at.ord")


def common_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have, each once; a null key counts as a key."""
    return first.select(key).intersect(second.select(key))


def unshared_keys(first: DataFrame, second: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys that one side alone has, each once, with that side's name as `side`."""
    one, two = first.select(key), second.select(key)
    return one.subtract(two).select(key, F.lit(names[0]).alias("side")).unionByName(two.subtract(one).select(key, F.lit(names[1]).alias("side")))
