"""Sources and sinks: annotations, documents, keyed CSV, image files, reports.

Reads go through Spark's readers only, so any file system that Spark knows serves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import strip
from ..operators.validate import checked_keys, with_order

IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def require_directory(spark: SparkSession, path: str, what: str = "directory") -> str:
    """path, or an error if there is no such directory in its file system."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target) or not fs.getFileStatus(target).isDirectory():
        raise FileNotFoundError(f"{what} {path} does not exist")
    return path


def scan_files(spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """Files with one of the suffixes, in any case: path, order (path components to sort by), and content if wanted.

    Without content only names are read. The result is not sorted.
    """
    require_directory(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.filter(suffix.isin(suffixes)).select("path", F.split("path", "/").alias("order"), *(["content"] if content else []))


def find_images(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Image files in order of path components; an error if there are none."""
    found = scan_files(spark, root, IMAGE_SUFFIXES, recursive)
    if found.isEmpty():
        raise FileNotFoundError(f"no images found in {root}")
    return found.orderBy("order")


def read_annotations(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """path and data (variant) of each *.json file; JSON that is broken or no object is an error, or a null if not strict."""
    require_directory(spark, root)
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.select("path", F.try_parse_json("value").alias("data"))
    is_object = F.schema_of_variant("data").startswith("OBJECT")
    if not strict:
        return parsed.select("path", F.when(is_object, F.col("data")).alias("data"))
    name = F.element_at(F.split("path", "/"), -1)
    checked = (
        F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("Failed to parse "), name)).cast("string"))
        .when(~is_object, F.raise_error(F.concat(name, F.lit(" does not contain a JSON object"))).cast("string"))
        .otherwise("")
    )
    return parsed.withColumn("_ok", checked).filter("_ok = ''").drop("_ok")


def read_keyed_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV file with header, all strings, empty for null, with _ord in file order; keys must be there, filled and unique."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])
    return with_order(checked_keys(rows, key, path)).withColumn(key, strip(F.col(f"`{key}`")))


def write_csv(df: DataFrame, path: str) -> int:
    """df as one CSV file with header in the directory path; returns the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
    return seen.get["n"]


def documents_from_annotations(annotations: DataFrame) -> DataFrame:
    """path, text: the page transcript that an annotation carries, the text source that needs no OCR engine.

    path is that of the image beside the annotation, whose name the extracted row has.
    """
    from ..operators.ground_truth import annotation_text

    return annotations.select(F.regexp_replace("path", r"\.[^./]*$", ".jpg").alias("path"), annotation_text(F.col("data"), "OTHER").alias("text"))


def ocr_text(images: DataFrame, read, lang: str = "eng") -> DataFrame:
    """path, text of images (path, content), by a function of (bytes, lang) -> str; a failure of it gives ''."""
    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return read(bytes(raw), lang)
            except Exception:
                return ""

        return contents.map(one)

    return images.select("path", run("content").alias("text"))


@dataclass
class ExtractionConfig:
    """Settings of an extraction run, as a small key/value table or a dict may hold them."""

    images_dir: str
    lang: str = "eng"
    recursive: bool = False
    value_columns: list[str] = field(default_factory=list)

    @classmethod
    def from_mapping(cls, values: dict) -> ExtractionConfig:
        names = str(values.get("value_columns") or "").replace(";", ",").split(",")
        return cls(
            str(values["images_dir"]).strip(),
            str(values.get("lang") or "eng").strip() or "eng",
            str(values.get("recursive") or "").strip().lower() in {"1", "true", "yes", "y"},
            [n.strip() for n in names if n.strip()],
        )

    @classmethod
    def from_table(cls, settings: DataFrame) -> ExtractionConfig:
        """Settings from a key/value table: the columns name and value, one row a setting; of a repeated name the largest value counts."""
        names = ["images_dir", "lang", "recursive", "value_columns"]
        rows = settings.filter(F.col("name").isin(names)).groupBy("name").agg(F.max("value").alias("value")).collect()  # four rows at most
        return cls.from_mapping({"images_dir": "", **{r["name"]: r["value"] for r in rows}})


def resolve_folder(spark: SparkSession, value: str | None, bases: list[str], default: str) -> str:
    """The folder that a setting means: a file stands for its folder, a relative path is sought below each of bases, nothing is the default.

    A path that exists nowhere is taken below the first base.
    """
    raw = (value or "").strip()
    if not raw:
        return default
    absolute = raw.startswith("/") or "://" in raw or not bases
    tried = [raw] if absolute else [f"{b.rstrip('/')}/{raw}" for b in bases]
    for path in tried:
        fs, target = _file_system(spark, path)
        if fs.exists(target):
            return path if fs.getFileStatus(target).isDirectory() else path.rpartition("/")[0]
    return tried[0]
