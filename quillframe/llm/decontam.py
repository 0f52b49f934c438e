"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are folded to words; the hashes of all windows of n consecutive words of
the benchmark's items form a set. The windows of documents are hashed in numpy and
looked up; every hit is verified word by word before it counts.

The benchmark is counted first. Up to `block_words` item words, the set with the words
behind it is built once and broadcast, and no document is shuffled. Beyond that only a
bit table of fixed size goes to the executors: windows that it marks meet the
benchmark's windows in a join by shuffle, on the words themselves, and the hits go back to all
documents with the same text. Either way gives the same result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, materialize, mix64, table, window_hashes

#: Bytes that belong to words once A-Z are lowered: digits, a-z and all of non-ASCII.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


ADDED = ("_n_words", "_hits", "_items")


def fold_words(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _windows(items: list[tuple], n: int) -> dict[int, dict[tuple, list]]:
    """By window length: window words -> the items that hold it."""
    found: dict[int, dict[tuple, list]] = {}
    for item, words in items:
        size = min(n, len(words))
        if size:
            at = found.setdefault(size, {})
            for i in range(len(words) - size + 1):
                of = at.setdefault(tuple(words[i : i + size]), [])
                if item not in of:
                    of.append(item)
    return found


_TABLE_BITS = 20


def scan_tables(items: list[tuple], n: int) -> tuple[dict, np.ndarray, list]:
    """What finds the items' windows in texts, as plain values: executors read a broadcast without this package.

    Words of the items have numbers and random codes; other words are 0 and part
    a text into runs. By window size: a bit table, the sorted hashes of the windows, their words' numbers, and their items.
    """
    found = _windows(items, n)
    ids = {w: k for k, w in enumerate(sorted({w for at in found.values() for window in at for w in window}), 1)}
    codes = mix64(np.arange(1, len(ids) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sizes = []
    for size, windows in sorted(found.items()):
        owners = list(windows.values())
        numbers = np.array([[ids[w] for w in window] for window in windows])
        keys = np.concatenate([window_hashes(codes[row], size) for row in numbers])
        order = np.argsort(keys)
        marks = np.zeros(1 << _TABLE_BITS, bool)
        marks[keys >> np.uint64(64 - _TABLE_BITS)] = True
        sizes.append((size, marks, keys[order], numbers[order], [owners[k] for k in order]))
    return ids, codes, sizes


def find_windows(tables: tuple[dict, np.ndarray, list], words: list[bytes]) -> tuple[list[int], set]:
    """Word ranges, flattened, and ids of items.

    Only runs as long as a window are hashed. A window's hash must be marked in the bit
    table, then stand in the sorted array of hashes, then the words must be equal.
    """
    numbers_of, codes, sizes = tables
    hits, items = [], set()
    ids = np.fromiter(map(numbers_of.get, words, repeat(0)), np.int64, len(words))
    gaps = np.flatnonzero(np.concatenate([[True], ids == 0, [True]]))
    lengths = np.diff(gaps) - 1
    for size, marks, keys, numbers, owners in sizes:
        for run in np.flatnonzero(lengths >= size):
            start = int(gaps[run])
            own = ids[start : start + int(lengths[run])]
            hashed = window_hashes(codes[own], size)
            for i in np.flatnonzero(marks[hashed >> np.uint64(64 - _TABLE_BITS)]):
                k = int(np.searchsorted(keys, hashed[i]))
                while k < len(keys) and keys[k] == hashed[i]:
                    if np.array_equal(numbers[k], own[i : i + size]):
                        hits += [start + int(i), start + int(i) + size]
                        items.update(owners[k])
                    k += 1
    return hits, items


def _scan(shared, names: list[str], text_col: str, added: list[str]):
    """A mapInArrow function that adds the number of words, the hits (word ranges) and the items from broadcast tables."""

    def run(batches):
        tables = shared.value
        for batch in batches:
            hits_out, items_out, n_out = [], [], []
            for text in batch.column(text_col):
                words = fold_words(text.as_py())
                found, owners = find_windows(tables, words)
                n_out.append(len(words))
                hits_out.append(_union(found))
                items_out.append(sorted(x for x in owners if x is not None))
            cols = [batch.column(c) for c in names] + [pa.array(n_out, pa.int64()), pa.array(hits_out, pa.list_(pa.int64())), pa.array(items_out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    return run


_KEY = "sha2(cast(coalesce({0}, '') as binary), 256)"
_MARK_BITS = 24


def _window_rows(n: int, sizes: list[int] | None, marked=None):
    """Rows (key, text) -> (key, size, at, x): windows as their words joined by spaces.

    sizes None: an item's own windows, of n words or of all where there are fewer.
    marked: the broadcast bit table that a window's hash must be marked in.
    """

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                words = fold_words(text.as_py())
                size_out, at_out, x_out = [], [], []
                for size in ([min(n, len(words))] if words else []) if sizes is None else sizes:
                    for at in range(len(words) - size + 1):
                        x = b" ".join(words[at : at + size])
                        if marked is None or marked.value[xxhash.xxh32_intdigest(x) >> (32 - _MARK_BITS)]:
                            size_out.append(size), at_out.append(at), x_out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(x_out), batch.schema.field("key").type), pa.array(size_out, pa.int32()), pa.array(at_out, pa.int32()), pa.array(x_out, pa.binary())], names=["key", "size", "at", "x"])

    return run


def _marks(windows: DataFrame) -> np.ndarray:
    """A bit table of 2**_MARK_BITS entries, whatever the number of windows."""

    def run(batches):
        marks = np.zeros(1 << _MARK_BITS, bool)
        for batch in batches:
            for x in batch.column("x").to_pylist():
                marks[xxhash.xxh32_intdigest(x) >> (32 - _MARK_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(marks), pa.int32())], names=["cell"])

    cells = windows.select("x").mapInArrow(run, "cell int").distinct().toArrow().column("cell").to_numpy()
    marks = np.zeros(1 << _MARK_BITS, bool)
    marks[cells] = True
    return marks


def _hits_by_join(docs: DataFrame, benchmark: DataFrame, n: int, names: list[str], text_col: str, added: list[str], schema: T.StructType) -> DataFrame:
    spark = docs.sparkSession
    items = materialize(benchmark.select(F.col("id").alias("key"), "text").mapInArrow(_window_rows(n, None), "key string, size int, at int, x binary").select(F.col("key").alias("item"), "size", "x").distinct(), "benchmark-windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # n values at most
    marked = spark.sparkContext.broadcast(_marks(items))
    key = F.expr(_KEY.format(f"`{text_col}`"))
    spots = docs.select(key.alias("key"), F.col(text_col).alias("text")).mapInArrow(_window_rows(n, sizes, marked), "key string, size int, at int, x binary")
    met = spots.distinct().join(items, ["size", "x"])
    per = met.groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("spots"), F.collect_set("item").alias("items"))
    text_key, spots_col, items_col = fresh([*names, *added], "text_key", "spots", "items")
    per = materialize(per, "benchmark-hits").toDF(text_key, spots_col, items_col)
    joined = docs.join(per, key == F.col(text_key), "left").drop(text_key)

    def run(batches):
        for batch in batches:
            hits, n_out = [], []
            for text, found in zip(batch.column(text_col), batch.column(spots_col).to_pylist(), strict=True):
                n_out.append(len(fold_words(text.as_py())))
                hits.append(_union([x for f in found or [] for x in (f["at"], f["at"] + f["size"])]))
            items_out = [sorted(x or []) for x in batch.column(items_col).to_pylist()]
            cols = [batch.column(c) for c in names] + [pa.array(n_out, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items_out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    return joined.mapInArrow(run, schema)


def _union(hits: list[int]) -> list[int]:
    """Disjoint ascending ranges [start, end, start, end, ...] of the union of ranges."""
    out: list[int] = []
    for a, b in sorted(zip(hits[::2], hits[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, n=10, text_col="text", id_col="item_id", item_text_col="text", block_words=200_000, added=ADDED) -> DataFrame:
    """docs with _n_words, _hits (disjoint ranges of hit words, flattened) and _items (ids of items with windows in the text, as text).

    An item of fewer than n words, but not none, is one window. Null and wordless
    texts, on either side, have no hits; repeated items share their hits; an item
    with a null id hits like others and is left out of _items. An empty benchmark or
    table gives no hits. The columns are named as in added; columns of docs with these names are
    replaced. block_words bounds what goes to the driver and, with about 200 bytes a word, to executors.
    """
    docs = docs.drop(*added)
    names = docs.columns
    kinds = (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, kind) for c, kind in zip(added, kinds, strict=True)])
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(fold_words(t.as_py())) for t in batch.column("text")], pa.int64())], names=["n"])

    words = items.select("text").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if words > block_words:
        return _hits_by_join(docs, items, n, names, text_col, list(added), schema)
    tables = scan_tables([(r[0], fold_words(r[1])) for r in items.toLocalIterator()], n)
    return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(tables), names, text_col, list(added)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n=10, mode="document", text_col="text") -> DataFrame:
    """docs without benchmark content, in the columns of docs.

    mode "document" drops every document with a hit; mode "span" removes the hit
    words, with what stands between them, and leaves one space in their place.
    """
    added = fresh(docs.columns, *ADDED)
    hits = added[1]
    found = find_benchmark_hits(docs, benchmark, n=n, text_col=text_col, added=added)
    if mode == "document":
        return found.filter(F.size(hits) == 0).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts, ranges):
        return texts.combine(ranges, _cut_spans)

    cleaned = F.when(F.size(hits) == 0, F.col(text_col)).otherwise(cut(text_col, hits))
    return found.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _cut_spans(text, hits):
    if text is None or not len(hits):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2], strict=True):
        out += [raw[at : starts[a]], b" "]
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("_hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS size FROM iw WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win) s WHERE len(w) >= s.size)
), hits AS (
  SELECT spots.doc_id, spots.i, spots.size, win.item_id FROM spots JOIN win ON spots.x = win.x AND spots.size = win.size
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
