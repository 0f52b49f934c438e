"""Sharding along a Hilbert curve.

Each metadata dimension is cut into 2**bits levels, at approximate quantiles of
all rows for numbers, at exact ranks for text; a row's levels give its place on the Hilbert curve through the grid.
Rows sorted by that place are cut into runs whose counts differ by one at most,
so a shard covers a compact block of the grid and per-file minima and maxima
prune on every dimension.

A row's rank comes from counts, not from one sorted task: the curve has a fixed
number of cells, each cell is dealt into sub-cells by a hash of the row, the
counts of cells and of sub-cells are summed to offsets, and only rows of one
sub-cell are numbered together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, materialize, release, table

#: Grids of up to 2**TABLE_BITS cells have a table of places in the plan; larger ones compute them in numpy.
TABLE_BITS = 14


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points given as an (n, dims) array of levels below 2**bits.

    Skilling's transform from axes to transposed index, on all points at once,
    then the interleaving of the bits. dims * bits may be 62 at most.
    """
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dims * bits must not exceed 62")
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_cuts(docs: DataFrame, dim: str, levels: int, parts: int = 64) -> list[str]:
    """The values that cut a text column into levels of about equal counts, by exact ranks of whole strings.

    Distinct values are counted, range-partitioned and summed up partition by partition;
    what comes to the driver is a number per partition and levels - 1 values. Nulls don't count.
    """
    counts = docs.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    dealt = materialize(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted(dealt.groupBy("part").agg(F.min("v").alias("lo"), F.sum("k").alias("k")).collect(), key=lambda r: r["lo"].encode("utf-8", "surrogatepass"))
    total, offsets = 0, {}
    for r in sums:
        offsets[r["part"]] = total
        total += r["k"]
    if not total:
        return []
    before = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("part"))
    reached = before + F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    targets = [total * i / levels for i in range(1, levels)]
    found = dealt.select("v", reached.alias("reached")).agg(*[F.min(F.when(F.col("reached") >= t, F.col("v"))).alias(f"c{i}") for i, t in enumerate(targets)]).first()
    release(dealt)
    return list(found)


def with_hilbert(docs: DataFrame, dims: list[str], *, bits: int, out_col: str) -> DataFrame:
    """docs with each row's place on the curve: levels by comparison with the cuts of each dimension, places from a table of the grid."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    texts = [d for d in dims if isinstance(kinds[d], T.StringType)]
    numbers = {d: F.col(d).cast("double") for d in dims if d not in texts}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = {d: text_cuts(docs, d, 1 << bits) for d in texts}
    if numbers:
        found = docs.agg(*[F.percentile_approx(x, steps, 10_000).alias(f"q{i}") for i, x in enumerate(numbers.values())]).first()
        cuts |= {d: found[f"q{i}"] or [] for i, d in enumerate(numbers)}
    levels = []
    for d in dims:
        value, level = numbers.get(d, F.col(d)), F.lit(0)
        for cut in sorted(set(cuts[d])):
            level = level + F.when(value > F.lit(cut), 1).otherwise(0)
        levels.append(level)
    if len(dims) * bits <= TABLE_BITS:
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * len(dims), indexing="ij"), axis=-1).reshape(-1, len(dims))
        cell = F.lit(0)
        for level in levels:
            cell = cell * (1 << bits) + level
        return docs.withColumn(out_col, F.get(F.lit(hilbert_index(grid, bits)), cell))

    import pandas as pd

    def place(*cols):
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], axis=1), bits))

    return docs.withColumn(out_col, F.pandas_udf(place, "long", F.PandasUDFType.SCALAR)(*levels))


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int, *, bits=4, sub_cells=64, id_col="doc_id") -> DataFrame:
    """docs with hilbert long, shard int and slot long (from 0 in each shard, gapless).

    The order is by place on the curve, then by a hash of id_col, then by id_col
    and all other columns of simple types, so that repeated ids land alike in
    every run; rows equal in all of these are interchangeable. Nulls take the
    lowest level of their dimension. An empty table gives an empty result; with
    fewer rows than shards, shards hold one row or none. Columns of docs with
    the added names are replaced. Sizes of tables passed around: 2**(dims*bits)
    cells and sub_cells times as many sub-cells, whatever the input.
    """
    docs = docs.drop("hilbert", "shard", "slot")
    names = docs.columns
    h, sub, n, before, start, total, offset, rank, place = fresh([*names, "hilbert"], "h", "sub", "n", "before", "start", "total", "offset", "rank", "place")
    placed = with_hilbert(docs, dims, bits=bits, out_col="hilbert")
    placed = placed.withColumn(h, F.xxhash64(id_col)).withColumn(sub, F.pmod(F.col(h), F.lit(sub_cells)).cast("int"))
    counts = placed.groupBy("hilbert", sub).agg(F.count(F.lit(1)).alias(n))
    within = Window.partitionBy("hilbert").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    subs = counts.select("hilbert", sub, F.coalesce(F.sum(n).over(within), F.lit(0)).alias(before))
    ahead = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("hilbert").agg(F.count(F.lit(1)).alias(n))
    cells = cells.select("hilbert", F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(start), F.sum(n).over(Window.partitionBy()).alias(total))
    offsets = subs.join(F.broadcast(cells), "hilbert").select("hilbert", sub, (F.col(start) + F.col(before)).alias(offset), total)
    simple = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.TimestampType, T.DateType))]
    ties = [F.xxhash64(*[F.col(c) for c in simple])] if simple else []
    here = Window.partitionBy("hilbert", sub).orderBy(h, id_col, *ties)
    ranked = placed.join(offsets, ["hilbert", sub]).withColumn(rank, F.col(offset) + F.row_number().over(here) - 1)
    shard = F.expr(f"(`{rank}` * {n_shards}L) div `{total}`")
    first = F.expr(f"(`{place}` * `{total}` + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn(place, shard).select(*names, "hilbert", F.col(place).cast("int").alias("shard"), (F.col(rank) - first).alias("slot"))


def op1_hilbert_shards(spark, sf_dir: str, n_shards=24) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hilbert_shards(docs, ["source", "lang", "size"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
