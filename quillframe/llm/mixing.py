"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w gets the repetition rate
lambda = w * total / n. Each row inverts the Poisson distribution of that rate
at a uniform number hashed from the seed and its id, is exploded by the count,
and the copies are sorted globally by a hash of seed, id and copy number.
A rate too large to invert is drawn as a sum of independent parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, table

#: exp(-rate) stays above zero in doubles up to here; larger rates are drawn as the sum of equal parts below it.
MAX_RATE = 700.0
#: Copies that one step of the explosion makes at most, so that no array grows with the rate.
BLOCK = 4096


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution of this rate.

    As many terms as the far tail can need (rate + 12 standard deviations + 40),
    beyond which 52 bits cannot tell a sum from 1.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def poisson_counts(cdf: Column, us: Column) -> Column:
    """For each u of an array, the smallest k with P(X <= k) > u. The transform makes u a variable, computed once."""
    return F.transform(us, lambda x: F.size(F.filter(cdf, lambda c: c <= x)))


def poisson_count(cdf: Column, u: Column) -> Column:
    return F.get(poisson_counts(cdf, F.array(u)), F.lit(0))


def part_uniforms(seed: int, ident: Column, parts: Column) -> Column:
    """An independent number in (0, 1) for each part; the first is that of a row with one part."""
    first = F.array(uniform(seed, ident))
    more = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: uniform(f"{seed}.part", i.cast("string"), ident))
    return F.when(parts > 1, F.concat(first, more)).otherwise(first)


def source_rates(docs: DataFrame, targets: dict | None, *, source_col="source", total_factor=1.0) -> tuple[DataFrame, int]:
    """A row per source (source_col, n_rows, rate), counted over all rows of docs, and the number of sources.

    targets maps sources to weights (missing ones count 0, None: all sources equally);
    weights are divided by the sum of those whose source occurs.
    """
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_rows"))
    if targets is None:
        weighted = counts.withColumn("_w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"_s {docs.schema[source_col].dataType.simpleString()}, _w double")
        weighted = counts.join(given, counts[source_col].eqNullSafe(given["_s"]), "left").fillna(0.0, ["_w"]).drop("_s")
    all_w, all_n, sources = weighted.agg(F.sum("_w"), F.sum("n_rows"), F.count(F.lit(1))).first()
    rate = F.col("_w") / F.lit(all_w) * F.lit(all_n) * F.lit(total_factor) / F.col("n_rows") if all_w else F.lit(0.0)
    return weighted.select(source_col, "n_rows", rate.alias("rate")), sources


#: Sources up to which the table of rates goes to the executors: a source's cumulative sums are 8.5 kB at most.
BROADCAST_SOURCES = 5_000
#: Parts into which each source's rows are dealt for the join beyond that.
SALTS = 64


def with_rates(docs: DataFrame, rates: DataFrame, sources: int, on: Column, salt: str, ident: Column) -> DataFrame:
    """docs with the columns of rates, without a shuffle of docs where there are few sources; else dealt by source and salt, so no source is one task."""
    if sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), on)
    dealt = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.join(dealt, on & (F.pmod(F.xxhash64(ident), F.lit(SALTS)) == F.col(salt))).drop(salt)


ADDED = ("copy_no", "n_copies", "shuffle_key")


def poisson_mix(docs: DataFrame, targets: dict | None = None, *, seed=17, total_factor=1.0, id_col="doc_id", source_col="source", added=ADDED) -> DataFrame:
    """docs with each row repeated by its count, in globally shuffled order.

    Adds the columns named in added: the copy's number (from 0), the row's number
    of copies, and the key of the order; columns of docs with these names are
    replaced. A null source is a source of its own; a null id hashes as empty
    text. Rows that repeat an id share the draw, so their copies share keys; the
    order between such ties is free. An empty table gives an empty result. A rate
    above MAX_RATE is the sum of ceil(rate / MAX_RATE) Poisson draws of equal rates,
    which has that rate's distribution. A row has fewer than 2**31 copies, else the
    cast of its count fails.
    """
    docs = docs.drop(*added)
    names = docs.columns
    source, cdf, parts, start, salt = fresh([*names, *added], "source_of_rate", "cdf", "parts", "start", "salt")
    copy_no, n_copies, key = added
    rates, sources = source_rates(docs, targets, source_col=source_col, total_factor=total_factor)
    n_parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    rates = rates.filter("rate > 0").select(F.col(source_col).alias(source), n_parts.alias(parts), poisson_cdf(F.col("rate") / n_parts).alias(cdf))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    counted = with_rates(docs, rates, sources, F.col(source_col).eqNullSafe(F.col(source)), salt, ident)
    drawn = F.aggregate(poisson_counts(F.col(cdf), part_uniforms(seed, ident, F.col(parts))), F.lit(0).cast("long"), lambda n, k: n + k)
    counted = counted.withColumn(n_copies, drawn.cast("int")).drop(cdf, parts)
    blocks = counted.filter(F.col(n_copies) > 0).withColumn(start, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1, F.lit(BLOCK))))
    copies = blocks.withColumn(copy_no, F.explode(F.sequence(F.col(start), F.least(F.col(start) + (BLOCK - 1), F.col(n_copies) - 1))))
    keyed = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(f"{seed}.order"), ident, F.col(copy_no).cast("string")).cast("binary")))
    return keyed.select(*names, *added).repartitionByRange(F.col(key)).sortWithinPartitions(key)


def op2_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM c)) * (SELECT count(*) FROM documents) * 1.0::DOUBLE / n AS whole FROM c
), p AS (
  SELECT source, greatest(ceil(whole / 700.0), 1)::INTEGER AS parts, whole / greatest(ceil(whole / 700.0), 1)::INTEGER AS rate FROM r
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM p
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
), i AS (
  SELECT d.doc_id, d.source, unnest(range(p.parts)) AS i FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), u AS (
  SELECT doc_id, source, (('0x' || substr(md5(CASE WHEN i = 0 THEN '17:' ELSE '17.part:' || i::VARCHAR || ':' END || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM i
), counted AS (
  SELECT u.doc_id, count(*) FILTER (WHERE cdf.cdf <= u.u) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY u.doc_id
), copies AS (
  SELECT d.*, counted.n, unnest(range(counted.n)) AS copy_no FROM documents d JOIN counted ON counted.doc_id = d.doc_id WHERE counted.n > 0
)
SELECT * EXCLUDE (n, copy_no), copy_no::INTEGER AS copy_no, n::INTEGER AS n_copies,
  md5('17.order:' || doc_id::VARCHAR || ':' || copy_no::VARCHAR) AS shuffle_key
FROM copies
"""
