"""Row-by-row extraction as a stream of files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.extract import extract


def document_stream(spark: SparkSession, root: str, per_trigger: int = 1, glob: str = "*.txt") -> DataFrame:
    """path, text, started of text files as they come."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.current_timestamp().alias("started"))


def stream_rows(documents: DataFrame, sink: str, checkpoint: str, on_row: Callable | None = None, on_status: Callable[[str], None] | None = None, **options):
    """Start a query that appends extracted rows to a Parquet table; each batch replaces what a failed try of it left.

    The table is partitioned by batch_id. Rows carry written_ms, the time from the batch's start to its
    writing. on_row gets each written row, on_status a line `OCR: path [n | MM:SS]` for it with the number of rows so far,
    both best effort: their errors are printed.
    """
    columns = [c for c in documents.columns if c != "text"]
    done, began = [0], time.monotonic()

    def tell(hook: Callable | None, what) -> None:
        try:
            if hook is not None:
                hook(what)
        except Exception as error:
            print(f"callback failed: {error}")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = extract(batch, **options).join(batch.select(*columns), "path")
        timed = rows.withColumn("written_ms", F.expr("unix_millis(now()) - unix_millis(started)"))
        # a partition per batch: a second try overwrites the first one's files
        timed.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        if on_row is None and on_status is None:
            return
        for row in batch.sparkSession.read.parquet(f"{sink}/batch_id={batch_id}").toLocalIterator():
            done[0] += 1
            tell(on_status, f"OCR: {row['path']} [{done[0]} | {clock(time.monotonic() - began)}]")
            tell(on_row, row.asDict())

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency(rows: DataFrame, ms: Column | str = "written_ms") -> DataFrame:
    """rows, avg_ms, min_ms, max_ms, total_ms of a column of milliseconds."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return rows.agg(F.count(c).alias("rows"), F.avg(c).alias("avg_ms"), F.min(c).alias("min_ms"), F.max(c).alias("max_ms"), F.sum(c).alias("total_ms"))


def clock(seconds: float) -> str:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = int(seconds)
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60:02d}:{s % 60:02d}"


def elapsed(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on, as a column."""
    s = seconds.cast("int")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))
