"""Ground truth: nested annotations to fifteen string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pytext import collapse_spaces, lines, lstrip, strip

COLUMNS = ["Nomor", "Nama File", "Due Date", "PO Number", "Tel", "Email", "Site", "SUB_TOTAL", "DISCOUNT", "TAX", "TOTAL", "Bank Name", "Branch Name", "Bank Account Number", "Bank Swift Code"]
_AFTER_COLON = {"Due Date": "DUE_DATE", "PO Number": "PO_NUMBER", "SUB_TOTAL": "SUB_TOTAL", "DISCOUNT": "DISCOUNT", "TAX": "TAX", "TOTAL": "TOTAL"}
_LABELED = {"Tel": "BUYER", "Email": "BUYER", "Site": "BUYER", "Bank Name": "PAYMENT_DETAILS", "Branch Name": "PAYMENT_DETAILS", "Bank Account Number": "PAYMENT_DETAILS", "Bank Swift Code": "PAYMENT_DETAILS"}


def annotation_text(data: Column, key: str) -> Column:
    """Text of an entry of a variant object: its `text` if that is a string, or the entry itself if it is one, else ''."""

    def string_at(path):
        kind = F.schema_of_variant(F.try_variant_get(data, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(data, path, "string"))

    return strip(F.coalesce(string_at(f"$.{key}.text"), string_at(f"$.{key}"), F.lit("")))


def value_after_colon(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, r"(?s)\A[^:]*:", ""))


def labeled_line(block: Column, label: str) -> Column:
    """What follows label on the first line that starts with it, in any case."""
    own = F.get(F.filter(F.transform(lines(block), lambda x: strip(x)), lambda x: F.startswith(F.lower(x), F.lit(label.lower()))), F.lit(0))
    return F.coalesce(collapse_spaces(lstrip(F.substr(own, F.lit(len(label) + 1)), " :")), F.lit(""))


def ground_truth(annotations: DataFrame) -> DataFrame:
    """annotations (path, data variant) as COLUMNS, all strings, numbered in order of path components."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    values = {"Nama File": F.concat(stem, F.lit(".jpg"))}
    values |= {name: value_after_colon(annotation_text(F.col("data"), key)) for name, key in _AFTER_COLON.items()}
    values |= {name: labeled_line(annotation_text(F.col("data"), key), name) for name, key in _LABELED.items()}
    rows = annotations.select(F.split("path", "/").alias("_order"), *[values[c].alias(c) for c in COLUMNS[1:]])
    return number_rows(rows, "_order", "Nomor").select(*COLUMNS)


def number_rows(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """rows with a column of 1..n as text in the order of one or several columns, nulls last.

    Rows equal in all of them are numbered as they come; columns that tell all rows apart give the same numbers in every run.

    A rank over all rows has one sequence, so the rows meet in one task; they are
    as many as there are annotation files, and narrow.
    """
    by = [F.col(c).asc_nulls_last() for c in ([order] if isinstance(order, str) else order)]
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("string"))
