"""Keyed comparison of an extracted relation with a true one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import strip


def with_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """df with an ascending number in file order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys, stripped, that occur more than once: key, n."""
    return df.groupBy(strip(F.col(key).cast("string")).alias(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def blank_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.coalesce(strip(F.col(key).cast("string")), F.lit("")) == "")


def checked_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, after an error where a key is missing, blank or double."""
    if key not in df.columns:
        raise ValueError(f"Key column '{key}' not found in {name}")
    if not blank_keys(df, key).isEmpty():
        raise ValueError(f"Missing key '{key}' in {name}")
    double = duplicate_keys(df, key).first()
    if double is not None:
        raise ValueError(f"Duplicate key '{double[0]}' detected in {name}")
    return df


def ordered_union(first: list[str], second: list[str]) -> list[str]:
    return list(dict.fromkeys([*first, *second]))


def _value(df: DataFrame, column: str, key: str) -> Column:
    return strip(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in df.columns else F.lit("")


@dataclass
class Validation:
    """What a comparison found, lazily.

    overall: one row of totals and rates. columns: a row per column. mismatches:
    column, key, expected, ocr, ord. missing_in_ground_truth and missing_in_ocr:
    key, ord. Rates are null where there is nothing to divide by.
    """

    key: str
    names: list[str]
    overall: DataFrame
    columns: DataFrame
    mismatches: DataFrame
    missing_in_ground_truth: DataFrame
    missing_in_ocr: DataFrame


def compare(gt: DataFrame, ocr: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """One row per key of either side: key, ord, in_gt, in_ocr, cells array<struct<column, expected, ocr>>.

    One join of whole rows; columns are spread out only after it, so what moves is a
    row per key and not a row per cell.
    """
    names = ordered_union([c for c in gt.columns if c != "_ord"], [c for c in ocr.columns if c != "_ord"])

    def side(df, tag):
        ordered = df if "_ord" in df.columns else with_order(df)
        return ordered.select(strip(F.col(key).cast("string")).alias("_key"), F.col("_ord").alias(f"_ord_{tag}"), F.struct(*[_value(df, c, key).alias(f"c{i}") for i, c in enumerate(names)]).alias(tag))

    joined = side(gt, "gt").join(side(ocr, "ocr"), "_key", "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"gt.c{i}").alias("expected"), F.col(f"ocr.c{i}").alias("ocr")) for i, c in enumerate(names)])
    return joined.select(
        F.col("_key").alias("key"),
        F.struct(F.col("gt").isNull().alias("later"), F.coalesce("_ord_gt", "_ord_ocr").alias("at")).alias("ord"),
        F.col("gt").isNotNull().alias("in_gt"),
        F.col("ocr").isNotNull().alias("in_ocr"),
        cells.alias("cells"),
    ), names


def rate(part: Column, whole: Column) -> Column:
    """part / whole, half even on four places; null for a whole of zero."""
    return F.bround(part.cast("double") / F.nullif(whole, F.lit(0)), 4)


def validate(gt: DataFrame, ocr: DataFrame, key: str, max_samples: int | None = None) -> Validation:
    """Compare the rows of both sides that share a key, cell by cell, as stripped strings; missing columns count as empty."""
    compared, names = compare(gt, ocr, key)
    both = compared.filter("in_gt and in_ocr")
    cells = both.select("key", "ord", F.inline("cells"))
    differs, missing = F.col("expected") != F.col("ocr"), (F.col("expected") != "") & (F.col("ocr") == "")
    counted = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("total_compared"),
        F.count_if(~differs).alias("matches"),
        F.count_if(differs).alias("mismatches"),
        F.count_if(differs & missing).alias("missing"),
    )
    columns = counted.withColumns({"accuracy": rate(F.col("matches"), F.col("total_compared")), "missing_rate": rate(F.col("missing"), F.col("total_compared"))})
    columns = columns.select("column", "total_compared", "matches", "mismatches", "accuracy", "missing", "missing_rate")
    unlike = F.filter("cells", lambda c: c["expected"] != c["ocr"])
    lacking = F.filter("cells", lambda c: (c["expected"] != "") & (c["ocr"] == ""))
    shared = F.col("in_gt") & F.col("in_ocr")
    n = F.lit(len(names))
    totals = compared.agg(
        F.count_if("in_gt").alias("total_records_ground_truth"),
        F.count_if("in_ocr").alias("total_records_ocr"),
        F.count_if(shared).alias("shared_records"),
        F.count_if(~F.col("in_gt")).alias("missing_in_ground_truth"),
        F.count_if(~F.col("in_ocr")).alias("missing_in_ocr_results"),
        F.count_if(shared & (F.size(unlike) == 0)).alias("rows_passing"),
        F.count_if(shared & (F.size(lacking) > 0)).alias("rows_missing"),
        F.coalesce(F.sum(F.when(shared, n - F.size(unlike))), F.lit(0)).alias("total_matches"),
        F.coalesce(F.sum(F.when(shared, F.size(lacking))), F.lit(0)).alias("overall_missing"),
        F.coalesce(F.sum(F.when(shared, n)), F.lit(0)).alias("total_field_comparisons"),
    )
    overall = totals.withColumn("rows_compared", F.col("shared_records")).withColumns(
        {
            "overall_accuracy": rate(F.col("total_matches"), F.col("total_field_comparisons")),
            "row_pass_rate": rate(F.col("rows_passing"), F.col("rows_compared")),
            "row_missing_rate": rate(F.col("rows_missing"), F.col("rows_compared")),
            "overall_missing_rate": rate(F.col("overall_missing"), F.col("total_field_comparisons")),
        }
    )
    mismatches = cells.filter(differs).select("column", "key", "expected", "ocr", "ord")
    if max_samples is not None:
        ranked = mismatches.withColumn("_rank", F.row_number().over(Window.partitionBy("column").orderBy("ord")))
        mismatches = ranked.filter(F.col("_rank") <= max_samples).drop("_rank")
    return Validation(
        key,
        names,
        overall,
        columns,
        mismatches,
        compared.filter("not in_gt").select("key", "ord"),
        compared.filter("not in_ocr").select("key", "ord"),
    )
