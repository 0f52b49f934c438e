"""Refreshing a working set: archive what is there, pair, sample, copy, convert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ground_truth import ground_truth
from ..operators.sample import pair_candidates, sample_rows, stem
from ..sources import files, sinks

IMAGE_SOURCES = [".jpg", ".jpeg"]


@dataclass
class Refreshed:
    archived: list[str]
    annotations: list[str]
    images: list[str]
    rows: int


def convert(spark: SparkSession, input_dir: str, output: str) -> int:
    """The ground truth of a folder of annotations as CSV; the number of rows."""
    return files.write_csv(ground_truth(files.read_annotations(spark, input_dir)), output)


def refresh(
    spark: SparkSession, *, source_annotations: str, source_images: str, annotations_dir: str, images_dir: str, archive_dir: str, output: str, pairs: int = 5, seed: int = 0, prefix: str = "Template"
) -> Refreshed:
    """Move the working annotations and images to the archive, then copy a sample of pairs in and convert it.

    A pair is an annotation and an image of one stem that begins with prefix. The
    sample is checked before anything moves; too few pairs are a ValueError.
    """
    found = [files.scan_files(spark, d, s).select("path").withColumn("stem", stem("path")) for d, s in ((source_annotations, [".json"]), (source_images, IMAGE_SOURCES))]
    picked = sample_rows(pair_candidates(*found, prefix=prefix), pairs, seed, "stem").collect()  # `pairs` rows
    archived = []
    for folder, suffixes in ((annotations_dir, [".json"]), (images_dir, IMAGE_SOURCES)):
        fs, target = files._file_system(spark, folder)
        if fs.exists(target):
            here = sorted(r["path"] for r in files.scan_files(spark, folder, suffixes, recursive=False).select("path").collect())
            archived += sinks.move_files(spark, here, archive_dir)
    one = sinks.copy_files(spark, [r["left_path"] for r in picked], annotations_dir)
    two = sinks.copy_files(spark, [r["right_path"] for r in picked], images_dir)
    return Refreshed(archived, one, two, convert(spark, annotations_dir, output))
