"""Command lines: python -m quillframe.cli convert | extract | validate | refresh.

A run ends with 0, with 1 where a file, folder, key or number of pairs is not as asked,
and with 2 where the arguments themselves are wrong.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time

LOG = logging.getLogger("quillframe")


def duration(ms: float | None) -> str:
    """Milliseconds as `N ms (S.SSs)`, or N/A."""
    return "N/A" if ms is None else f"{ms:.0f} ms ({ms / 1000:.2f}s)"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillframe")
    commands = top.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="annotations to a ground-truth CSV")
    convert.add_argument("input_dir")
    convert.add_argument("--output", required=True)
    extract = commands.add_parser("extract", help="transcripts of annotations to a CSV of cleaned fields")
    extract.add_argument("--annotations-dir", required=True)
    extract.add_argument("--output", required=True)
    extract.add_argument("--value-columns", default="", help="names, parted by commas")
    extract.add_argument("--pattern", help="a key/value pattern with two groups")
    extract.add_argument("--validate-against", help="a ground-truth CSV to validate the result with")
    validate = commands.add_parser("validate", help="compare two keyed CSVs")
    validate.add_argument("--ground-truth", required=True)
    validate.add_argument("--ocr", required=True)
    validate.add_argument("--key", default="Nama File")
    validate.add_argument("--max-samples", type=int)
    for name in ("--json-out", "--html-out", "--log-file"):
        validate.add_argument(name)
    refresh = commands.add_parser("refresh", help="archive the working set, sample new pairs, convert")
    for name in ("--source-annotations", "--source-images", "--annotations-dir", "--images-dir", "--archive-dir", "--output"):
        refresh.add_argument(name, required=True)
    refresh.add_argument("--pairs", type=int, default=5)
    refresh.add_argument("--seed", type=int, default=0)
    refresh.add_argument("--prefix", default="Template")
    return top


def run_convert(spark, a) -> None:
    from .plans.refresh import convert

    LOG.info("%d rows", convert(spark, a.input_dir, a.output))


def run_extract(spark, a) -> None:
    from .operators.fields import KV_PATTERN
    from .plans import extract
    from .sources import files

    config = files.ExtractionConfig.from_mapping({"images_dir": a.annotations_dir, "value_columns": a.value_columns})
    pattern = extract.check_pattern(spark, a.pattern) if a.pattern else KV_PATTERN
    documents = files.documents_from_annotations(files.read_annotations(spark, config.images_dir))
    LOG.info("%d rows", files.write_csv(extract.numbered(extract.extract(documents, value_columns=config.value_columns, pattern=pattern)), a.output))
    if a.validate_against:
        report_on(spark, a.validate_against, a.output, "Nama File", None)


def report_on(spark, truth: str, found: str, key: str, max_samples: int | None, **outputs) -> dict:
    from .operators.validate import validate
    from .plans import report
    from .sources import files, sinks

    result = report.as_dict(validate(files.read_keyed_csv(spark, truth, key), files.read_keyed_csv(spark, found, key), key, max_samples))
    sinks.write_report(spark, result, **outputs)
    LOG.info(report.log_line(result))
    return result


def run_validate(spark, a) -> None:
    report_on(spark, a.ground_truth, a.ocr, a.key, a.max_samples, json_out=a.json_out, html_out=a.html_out, log_file=a.log_file)


def run_refresh(spark, a) -> None:
    from .plans.refresh import refresh

    names = ("source_annotations", "source_images", "annotations_dir", "images_dir", "archive_dir", "output", "pairs", "seed", "prefix")
    done = refresh(spark, **{n: getattr(a, n) for n in names})
    LOG.info("%d files archived, %d pairs copied, %d rows", len(done.archived), len(done.images), done.rows)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillframe").getOrCreate()
    began = time.perf_counter()
    try:
        {"convert": run_convert, "extract": run_extract, "validate": run_validate, "refresh": run_refresh}[args.command](spark, args)
    except Exception as error:  # the first line says what is wrong; Spark's own errors carry the plan below it
        LOG.error(str(error).strip().split("\n")[0] or type(error).__name__)
        return 1
    LOG.info("took %s", duration((time.perf_counter() - began) * 1000))
    return 0


if __name__ == "__main__":
    sys.exit(main())
