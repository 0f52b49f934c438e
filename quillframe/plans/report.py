"""Reports of a validation: dict, JSON, HTML and the run log.

Reports have a row per column and a list of mismatches; use max_samples where
there may be many of these, since a report is put together on the driver.
"""

from __future__ import annotations

import html
import json
from datetime import datetime

from ..operators.validate import Validation

RATES = ["overall_accuracy", "row_pass_rate", "row_missing_rate", "overall_missing_rate"]


def as_dict(v: Validation) -> dict:
    """The report with its keys in their fixed order."""
    total = v.overall.first()
    per = {r["column"]: r for r in v.columns.collect()}
    unlike: dict[str, list] = {n: [] for n in v.names}
    for r in sorted(v.mismatches.collect(), key=lambda r: r["ord"]):
        unlike[r["column"]].append({v.key: r["key"], "expected": r["expected"], "ocr": r["ocr"]})
    ordered = lambda df: [r["key"] for r in sorted(df.collect(), key=lambda r: r["ord"])]
    counts = ["total_compared", "matches", "mismatches", "accuracy", "missing", "missing_rate"]
    empty = {"total_compared": 0, "matches": 0, "mismatches": 0, "accuracy": None, "missing": 0, "missing_rate": None}
    return {
        "key_column": v.key,
        "total_records_ground_truth": total["total_records_ground_truth"],
        "total_records_ocr": total["total_records_ocr"],
        "shared_records": total["shared_records"],
        "missing_in_ground_truth": ordered(v.missing_in_ground_truth),
        "missing_in_ocr_results": ordered(v.missing_in_ocr),
        "overall_accuracy": total["overall_accuracy"],
        "rows_compared": total["rows_compared"],
        "rows_passing": total["rows_passing"],
        "rows_missing": total["rows_missing"],
        "row_pass_rate": total["row_pass_rate"],
        "row_missing_rate": total["row_missing_rate"],
        "overall_missing": total["overall_missing"],
        "overall_missing_rate": total["overall_missing_rate"],
        "total_field_comparisons": total["total_field_comparisons"],
        "columns": {n: ({c: per[n][c] for c in counts} if n in per else dict(empty)) | {"missmatch": unlike[n]} for n in v.names},
    }


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2) + "\n"


def percent(value: float | None) -> str:
    return "–" if value is None else f"{value * 100:.2f}%"


def share(part: int | None, whole: int | None, unit: str) -> str:
    return "–" if not whole else f"{part} dari {whole} {unit}"


def as_html(report: dict) -> str:
    """A page with the totals as cards, the missing keys and a table of columns with their mismatches."""
    e = lambda x: html.escape(str(x))
    rows, cells = report["rows_compared"], report["total_field_comparisons"]
    matches = sum(c["matches"] for c in report["columns"].values())
    cards = [
        ("Akurasi keseluruhan", percent(report["overall_accuracy"]), share(matches, cells, "field")),
        ("Baris lolos", percent(report["row_pass_rate"]), share(report["rows_passing"], rows, "baris")),
        ("Baris dengan data hilang", percent(report["row_missing_rate"]), share(report["rows_missing"], rows, "baris")),
        ("Field hilang", percent(report["overall_missing_rate"]), share(report["overall_missing"], cells, "field")),
    ]
    out = ["<!DOCTYPE html>", "<html lang='id'><head><meta charset='utf-8'><title>Laporan validasi</title></head><body>", "<h1>Laporan validasi</h1>", "<section class='cards'>"]
    out += [f"<div class='card'><h2>{e(t)}</h2><p>{e(a)}</p><small>{e(b)}</small></div>" for t, a, b in cards]
    out.append("</section>")
    for title, keys in (("Tidak ada di ground truth", report["missing_in_ground_truth"]), ("Tidak ada di hasil OCR", report["missing_in_ocr_results"])):
        out.append(f"<h2>{e(title)}</h2>" + ("<ul>" + "".join(f"<li>{e(k)}</li>" for k in keys) + "</ul>" if keys else "<p>–</p>"))
    out.append("<table><tr><th>Kolom</th><th>Dibandingkan</th><th>Cocok</th><th>Akurasi</th><th>Hilang</th><th>Contoh</th></tr>")
    for name, c in report["columns"].items():
        samples = "".join(f"<li>{e(m[report['key_column']])}: {e(m['expected'])} / {e(m['ocr'])}</li>" for m in c["missmatch"])
        out.append(f"<tr><td>{e(name)}</td><td>{c['total_compared']}</td><td>{c['matches']}</td><td>{percent(c['accuracy'])}</td><td>{c['missing']} ({percent(c['missing_rate'])})</td><td><ul>{samples}</ul></td></tr>")
    return "\n".join([*out, "</table></body></html>"]) + "\n"


def log_line(report: dict, now: datetime | None = None) -> str:
    """One line of the run log."""
    four = lambda x: "N/A" if x is None else f"{x:.4f}"
    parts = [("accuracy", "overall_accuracy"), ("row_pass_rate", "row_pass_rate"), ("row_missing_rate", "row_missing_rate"), ("overall_missing_rate", "overall_missing_rate")]
    stamp = (now or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    rates = [f"{name}: {four(report[k])}" for name, k in parts]
    return " | ".join([stamp, *rates, f"total_groundtruth: {report['total_records_ground_truth']}", f"total_ocr: {report['total_records_ocr']}"])


def append_log(spark, report: dict, path: str, now: datetime | None = None) -> None:
    spark.createDataFrame([(log_line(report, now),)], "value string").coalesce(1).write.mode("append").text(path)
