"""Bounded training samples."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(key: Column, seed: int, rate: Column) -> Column:
    """Whether a hash of seed and key, as a number from 0 to 1, lies below rate; rates as small as 1e-15 still choose."""
    u = F.xxhash64(key, F.lit(seed)).cast("double") / float(1 << 64) + 0.5
    return (rate >= 1.0) | (u < rate)


def bounded_sample(rows: DataFrame, label: str, cap: int, *, key: Column, seed: int) -> tuple[DataFrame, dict]:
    """About cap rows of each label at most, chosen by a hash of key, and each label's rate.

    A label with fewer rows is taken whole. The counts behind the rates cover all
    rows; the sample is the same however rows are partitioned. Rows that repeat a key
    stand or fall together; a null key is one key. Rows without a label are left out;
    without any row the sample is empty. One count per label comes to the driver,
    as many numbers as the model that learns the labels has outputs.
    """
    labelled = rows.filter(F.col(label).isNotNull())
    rates = {r[0]: min(1.0, cap / r[1]) for r in labelled.groupBy(label).count().collect()}
    if not rates:
        return rows.limit(0), {}
    of = F.create_map(*[F.lit(x) for x in chain.from_iterable(rates.items())])
    return labelled.filter(drawn(key, seed, F.coalesce(F.element_at(of, F.col(label)), F.lit(0.0)))), rates
