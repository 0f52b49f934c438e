"""Small files in any file system that Spark knows: reports, the run log, and moves and copies of file sets.

What passes through the driver here is a report's text, or a path per file of a
sample; contents of images and annotations are copied by the file system.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .files import _file_system


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """text as one UTF-8 file at path, over what was there."""
    fs, target = _file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None where there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def append_line(spark: SparkSession, path: str, line: str, *, newest_first: bool = False, separator: str = "") -> str:
    """One more line (or block) of a log file, at its end, or with newest_first at its head with a separator line between.

    The log is read and written anew, since not every file system can append.
    """
    before = read_text(spark, path) or ""
    block = line.rstrip("\n") + "\n"
    if newest_first:
        return write_text(spark, path, block + (f"{separator}\n" if separator and before else "") + before)
    return write_text(spark, path, before + ("" if not before or before.endswith("\n") else "\n") + block)


def write_report(spark: SparkSession, report: dict, *, json_out: str | None = None, html_out: str | None = None, log_file: str | None = None) -> None:
    """A validation's report as a JSON file, an HTML page and a line of the run log, each where a path is given."""
    from ..plans import report as shapes

    if json_out:
        write_text(spark, json_out, shapes.as_json(report))
    if html_out:
        write_text(spark, html_out, shapes.as_html(report))
    if log_file:
        append_line(spark, log_file, shapes.log_line(report))


def unique_destination(spark: SparkSession, folder: str, name: str) -> str:
    """A path in folder for name, with _1, _2 ... before its suffix until no file has it."""
    fs, _ = _file_system(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    found, k = f"{folder.rstrip('/')}/{name}", 0
    while fs.exists(path(found)):
        k += 1
        found = f"{folder.rstrip('/')}/{stem}_{k}{suffix}"
    return found


def move_files(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Move files into folder, which is made, under unique names; the new paths."""
    fs, target = _file_system(spark, folder)
    fs.mkdirs(target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for p in paths:
        new = unique_destination(spark, folder, p.rsplit("/", 1)[-1])
        if not fs.rename(path(p), path(new)):
            raise OSError(f"{p} could not be moved to {new}")
        out.append(new)
    return out


def copy_files(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Copy files into folder, which is made, over files of their names, with their modification times."""
    fs, target = _file_system(spark, folder)
    fs.mkdirs(target)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        source = jvm.org.apache.hadoop.fs.Path(p)
        new = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{p.rsplit('/', 1)[-1]}")
        origin = source.getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileUtil.copy(origin, source, fs, new, False, True, conf)
        status = origin.getFileStatus(source)
        fs.setTimes(new, status.getModificationTime(), -1)
        out.append(new.toString())
    return out
