"""Tokens of images and second readings of line regions, by functions that an OCR engine's binding supplies.

Both keep to one image a call; what a function raises counts as nothing read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a token reader gives, beside text.
PLACES = ["page_num", "block_num", "par_num", "line_num", "left", "top", "width", "height"]
_TOKEN = "path string, pos int, text string, " + ", ".join(f"{c} int" for c in PLACES)
#: Pixels around a line that its second reading takes in.
PAD = 4


def ocr_tokens(images: DataFrame, read: Callable[[bytes, str], list[dict]], lang: str = "eng", prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """A row per token of images (path, content): path, pos, text and PLACES, as layout.group_lines takes them.

    read gives an image's tokens as dicts in reading order; prepare, where given, has the image first (grey, contrast, sharpening).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    raw = content.as_py()
                    found = list(read(prepare(raw) if prepare else raw, lang))
                except Exception:
                    found = []
                cols = [pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([t.get("text") or "" for t in found], pa.string())]
                cols += [pa.array([int(t.get(c) or 0) for t in found], pa.int32()) for c in PLACES]
                yield pa.RecordBatch.from_arrays(cols, names=["path", "pos", "text", *PLACES])

    return images.select("path", "content").mapInArrow(run, _TOKEN)


def region(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, pad: int = PAD) -> Column:
    """struct<left, top, right, bottom> of a line with its surroundings within the image, null where nothing is left."""
    box = F.struct(F.greatest(left - pad, F.lit(0)).alias("left"), F.greatest(top - pad, F.lit(0)).alias("top"), F.least(right + pad, width).alias("right"), F.least(bottom + pad, height).alias("bottom"))
    return F.when((box["right"] > box["left"]) & (box["bottom"] > box["top"]), box)


def reread_lines(lines: DataFrame, images: DataFrame, read: Callable[[bytes, dict, str], str], lang: str = "eng") -> DataFrame:
    """lines (doc_id, left, top, right, bottom, ...) with `refined`, a second reading of each line's region.

    images: doc_id, content, image_width, image_height. read(content, box, lang) crops, enlarges and
    reads; white space is collapsed. An image travels once, with all boxes of its lines. Lines without an
    image, and those whose region is empty, have ''.
    """
    at = F.struct("left", "top", "right", "bottom")
    boxes = lines.groupBy("doc_id").agg(F.collect_set(at).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(content: bytes, box: dict | None) -> str:
            try:
                return "" if box is None else " ".join(str(read(content, box, lang)).split())
            except Exception:
                return ""

        for batch in batches:
            texts = [[one(c.as_py(), box) for box in bs.as_py()] for c, bs in zip(batch.column("content"), batch.column("regions"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("boxes"), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "boxes", "texts"])

    padded = F.transform("boxes", lambda b: region(b["left"], b["top"], b["right"], b["bottom"], F.col("image_width"), F.col("image_height")))
    asked = images.join(boxes, "doc_id").select("doc_id", "content", "boxes", padded.alias("regions"))
    texts = asked.mapInArrow(run, T.StructType([asked.schema["doc_id"], asked.schema["boxes"], T.StructField("texts", T.ArrayType(T.StringType()))]))
    found = texts.select("doc_id", F.explode(F.arrays_zip("boxes", "texts")).alias("r")).select("doc_id", "r.boxes.*", F.col("r.texts").alias("refined"))
    joined = lines.drop("refined").join(found, ["doc_id", "left", "top", "right", "bottom"], "left")
    return joined.withColumn("refined", F.coalesce("refined", F.lit("")))
