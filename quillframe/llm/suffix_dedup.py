"""Removal of repeated passages with suffix arrays built by two-stage sorting.

Every byte covered by a string of `length` bytes that also starts elsewhere goes.

1. Anchors. In each window of `length` bytes the smallest hash of a gram of `gram`
   bytes is the window's anchor: equal windows have equal anchors. Neighbouring
   window starts with the same anchor, `length` of them at most, are a run, the bytes they
   cover a chunk. One row per different text.
2. Classes. Chunks are counted by (anchor, digest of the chunk): equal
   chunks form one class and are carried on once, with their count. Only
   classes that have company, a copy or another class at the same anchor,
   or in which the anchor moves, can hold a repeated window.
3. Suffix arrays. The classes of an anchor are dealt into parts of about `classes` each, nearly
   always one. A part's bytes are concatenated, and blocks of whole parts are sorted
   in two stages: suffixes smaller than their successor directly, all
   others induced by a scan over the buckets of first bytes. Neighbours in that
   order with a common prefix of `length` bytes are repeated windows.
4. Where an anchor has several parts, each part names its different windows, in the order of its
   suffix array, by their digest, and a count over parts finds those that
   occur once in theirs and also in another.
5. Repeated windows go back to all occurrences of their class and on to the
   texts, where their union is cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mix64, table

_RNG = np.random.default_rng(0x5AFE)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class GramHashes:
    """Hashes of all grams of `gram` consecutive bytes, by differences of prefix sums."""

    def __init__(self, gram: int):
        self.gram, self.up, self.down = gram, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def of(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[:n], out=sums[1:])
        return mix64((sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from running minima within blocks of w."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: bytes, length: int, hashes: GramHashes, segment_bits: int = 21) -> list[tuple[int, int, int, bool]]:
    """(hash, first window start, last window start, whether the anchor moves) for each run of windows with the same anchor.

    Where it doesn't move, no window of the run can equal another one of it. Long texts
    are taken in segments of 2**segment_bits window starts, which bounds the arrays, not the text.
    """
    found = []
    segment = 1 << segment_bits
    # positions take the low bits of the sorted keys, hashes the high ones
    at_bits = np.uint64((1 << (segment + length - 1).bit_length()) - 1)
    for base in range(0, len(raw) - length + 1, segment):
        h = hashes.of(np.frombuffer(raw, np.uint8, min(len(raw) - base, segment + length - 1), base))
        least = sliding_min((h & ~at_bits) | np.arange(len(h), dtype=np.uint64), length - hashes.gram + 1)
        moves = least[1:] != least[:-1]
        least &= ~at_bits
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        moved = np.concatenate([[0], np.cumsum(moves)])
        moving = moved[last] != moved[first]
        for x, lo, hi, own in zip(least[first].view(np.int64).tolist(), first.tolist(), last.tolist(), moving.tolist(), strict=True):
            found += [(x, base + at, base + min(hi, at + length - 1), own) for at in range(lo, hi + 1, length)]
    return found


def two_stage_suffixes(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of x (uint8, ending in its only value that no other is below) in order of their first depth bytes.

    The order of suffixes with depth equal bytes is free.
    """
    n = len(x)
    step = np.sign(np.diff(x.astype(np.int16)))
    # equal neighbours have the type of the next unequal ones
    at = np.where(step != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    smaller = np.zeros(n, bool)
    real = turn < n
    smaller[:-1][real] = step[turn[real]] > 0
    raw = x.tobytes()
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    heads = x[direct]
    bounds = np.searchsorted(heads, np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(x[-1])].append(np.array([n - 1], np.int64))
    out = []
    for c in range(256):
        first = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        parts = [first]
        while len(first):  # runs of c: each place that was just filled fills the next one
            before = first[first > 0] - 1
            first = before[x[before] == c]
            parts.append(first)
        here = np.concatenate([*parts, direct[bounds[c] : bounds[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        up = before[x[before] > c]
        if len(up):
            order = np.argsort(x[up], kind="stable")
            up = up[order]
            values, starts = np.unique(x[up], return_index=True)
            for v, part in zip(values, np.split(up, starts[1:]), strict=True):
                waiting[v].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def adjacent_prefixes(x: np.ndarray, order: np.ndarray, limit: int, rows=4096) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, up to limit; all must have limit bytes."""
    out = np.zeros(len(order), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(x, limit)
    for i in range(1, len(order), rows):
        pair = order[i - 1 : i + rows]
        both = windows[pair]
        unlike = both[1:] != both[:-1]
        out[i : i + len(unlike)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), limit)
    return out


def window_order(chunks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For several different chunks: the place in their concatenation where each begins, the starts of
    whole windows in the order of their suffixes, and which of these equal the one before."""
    sizes = np.array([len(c) for c in chunks])
    x = np.zeros(int(sizes.sum()) + len(chunks), np.uint8)
    # UTF-8 has no byte 255: adding one frees 0 for the ends of chunks
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    for b, c in zip(begins, chunks, strict=True):
        x[b : b + len(c)] = np.frombuffer(c, np.uint8) + 1
    order = two_stage_suffixes(x, length)
    whole = np.zeros(len(x), bool)
    for b, s in zip(begins, sizes, strict=True):
        whole[b : b + max(0, s - length + 1)] = True
    order = order[whole[order]]
    lcp = adjacent_prefixes(x, order, length) if len(order) else np.empty(0, np.int64)
    return begins, order, lcp >= length


def repeated_starts(chunks: list[bytes], length: int, ordered=None) -> list[np.ndarray]:
    """For each of several different chunks, which of its windows of length bytes occur again in any of them."""
    begins, order, twin = ordered or window_order(chunks, length)
    again = np.zeros(sum(map(len, chunks)) + len(chunks), bool)
    again[order[twin]] = True
    again[order[:-1][twin[1:]]] = True
    return [again[b : b + max(0, len(c) - length + 1)] for b, c in zip(begins, chunks, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


_ANCHOR_SQL = "array<struct<h:bigint,digest:binary,lo:int,hi:int,own:boolean>>"


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _find_anchors(length: int, gram: int):
    def run(batches):
        hashes = GramHashes(gram)
        for batch in batches:
            ends, found, digests = [0], [], []
            for text in batch.column("text"):
                raw = _raw(text.as_py())
                own = anchors(raw, length, hashes)
                found += own
                digests += [hashlib.blake2b(raw[lo : hi + length], digest_size=16).digest() for _, lo, hi, _ in own]
                ends.append(len(found))
            h, lo, hi, moving = zip(*found, strict=True) if found else ((), (), (), ())
            cols = [pa.array(h, pa.int64()), pa.array(digests, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(moving, pa.bool_())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, names=["h", "digest", "lo", "hi", "own"]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_id"), lists], names=["_key", "_id", "anchors"])

    return run


def _cut_chunks(length: int):
    """Rows of texts with the chunks wanted from them -> rows of chunks."""

    def run(batches):
        for batch in batches:
            h, digest, parts, chunk = [], [], [], []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = _raw(text.as_py())
                for w in wanted.as_py():
                    h.append(w["h"]), digest.append(w["digest"]), parts.append(w["parts"]), chunk.append(raw[w["lo"] : w["hi"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.binary()), pa.array(parts, pa.int32()), pa.array(chunk, pa.binary())], names=["h", "digest", "parts", "chunk"])

    return run


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_RUNS_SQL = "array<struct<s:int,e:int>>"


_SOLVED = f"h long, digest binary, runs {_RUNS_SQL}, windows array<struct<s:int,window:binary,alone:boolean>>"
_WINDOWS = pa.list_(pa.struct([("s", pa.int32()), ("window", pa.binary()), ("alone", pa.bool_())]))


def _sort_chunks(length: int, block: int):
    """Chunks ordered by (h, part) -> (h, digest, runs of repeated window starts within the chunk, windows).

    windows names each different window of the part at one place, for anchors in several parts, and
    tells whether it occurs there only; null for others.
    """

    def named(rows, ordered):
        """For each row its entries of windows."""
        begins, order, twin = ordered
        out: list[list] = [[] for _ in rows]
        heads = np.flatnonzero(~twin)
        alone = np.diff(np.concatenate([heads, [len(order)]])) == 1
        owner = np.searchsorted(begins, order[heads], side="right") - 1
        for at, k, one in zip(order[heads].tolist(), owner.tolist(), alone.tolist(), strict=True):
            if rows[k][3] > 1:
                s = at - int(begins[k])
                out[k].append({"s": s, "window": hashlib.blake2b(rows[k][2][s : s + length], digest_size=16).digest(), "alone": one})
        return out

    def solve(rows):
        chunks = [r[2] for r in rows]
        ordered = window_order(chunks, length)
        again = repeated_starts(chunks, length, ordered)
        windows = named(rows, ordered) if any(r[3] > 1 for r in rows) else [[]] * len(rows)
        found = [(r[0], r[1], [{"s": s, "e": e} for s, e in _runs(a)], w or None) for r, a, w in zip(rows, again, windows, strict=True)]
        found = [f for f in found if f[2] or f[3]]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], _RUNS), pa.array([f[3] for f in found], _WINDOWS)], names=["h", "digest", "runs", "windows"])

    def run(batches):
        rows, size, at, last = [], 0, None, None
        for batch in batches:
            cols = [batch.column(c) for c in ("h", "digest", "chunk", "parts", "part")]
            for i in range(batch.num_rows):
                *row, part = [c[i].as_py() for c in cols]
                if (row[0], row[1]) == last:  # rows that repeat an id and a text bring their chunks twice
                    continue
                # parts of one anchor never share a block: what is alone in its part would meet the other
                if rows and (row[0], part) != at and (size >= block or row[0] == rows[-1][0]):
                    yield solve(rows)
                    rows, size = [], 0
                at, last = (row[0], part), (row[0], row[1])
                rows.append(row)
                size += len(row[2])
        if rows:
            yield solve(rows)

    return run


def _cut_texts(length: int):
    def run(batches):
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                raw = _raw(text.as_py())
                gone = np.zeros(len(raw) + 1, np.int32)
                for r in runs.as_py():
                    gone[r["s"]] += 1
                    gone[r["e"] + length] -= 1
                out = np.cumsum(gone)[:-1] > 0
                size.append(len(raw))
                removed.append(int(out.sum()))
                spans.append(len(_runs(out)))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
            cols = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *cols], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length=400, gram=128, classes=400, block=1 << 18, id_col="doc_id", text_col="text") -> DataFrame:
    """A row per row of docs: id_col, n_bytes, n_removed, n_spans, kept binary (what remains), kept_sha256.

    Null texts count as empty. A text of length bytes or more that occurs in
    several rows goes in all of them, also in rows that repeat an id. Texts
    shorter than length have nothing removed; texts may be as long as a column
    holds. Cuts are made between bytes, so kept may not be whole UTF-8. An empty table
    gives an empty result; other columns are ignored. kept is null where nothing is
    removed, to spare a copy. classes and block bound what one sort holds: the different chunks
    of one anchor, each below 2 * length bytes, and the bytes of several small anchors.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text"))
    key = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    keyed = rows.withColumn("_key", key)
    id_type = docs.schema[id_col].dataType.simpleString()
    found = keyed.select("_key", "_id", "text").mapInArrow(_find_anchors(length, gram), f"_key binary, _id {id_type}, anchors {_ANCHOR_SQL}")
    texts = found.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("rep"), F.first("anchors").alias("anchors"))
    texts = materialize(texts, "anchors")
    places = texts.select("_key", "rep", "copies", F.inline("anchors"))
    counted = places.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "rep", "lo", "hi")).alias("at"), F.max("own").alias("own"))
    company = materialize(counted.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.max("own").alias("any_own")).filter("all > 1 or any_own").select("h", "k"), "anchor-classes")
    found = materialize(counted.join(company, "h"), "chunk-classes")
    parts = F.ceil(F.col("k") / classes).cast("int")
    wanted = found.filter("k > 1 or own").groupBy(F.col("at._key").alias("_key"), F.col("at.rep").alias("_id")).agg(
        F.collect_list(F.struct("h", "digest", parts.alias("parts"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))).alias("wanted")
    )
    same = keyed["_key"].eqNullSafe(F.col("w_key")) & keyed["_id"].eqNullSafe(F.col("w_id"))
    chunks = (
        keyed.join(wanted.withColumnsRenamed({"_key": "w_key", "_id": "w_id"}), same)
        .select("text", "wanted")
        .mapInArrow(_cut_chunks(length), "h long, digest binary, parts int, chunk binary")
    )
    dealt = chunks.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    solved = dealt.repartition("h", "part").sortWithinPartitions("h", "part", "digest").mapInArrow(_sort_chunks(length, block), _SOLVED)
    if found.filter(F.col("k") > classes).isEmpty():
        solved = solved.select("h", "digest", "runs")
    else:
        solved = materialize(solved, "solved")
        windows = solved.select("h", "digest", F.inline("windows"))
        twins = windows.groupBy("h", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "window")
        across = windows.filter("alone").join(twins, ["h", "window"]).groupBy("h", "digest").agg(F.collect_list(F.struct(F.col("s").alias("s"), F.col("s").alias("e"))).alias("runs"))
        solved = solved.select("h", "digest", "runs").unionByName(across)
    copied = found.filter("n > 1").select("h", "digest", F.array(F.struct(F.lit(0).alias("s"), (F.col("at.hi") - F.col("at.lo")).alias("e"))).alias("runs"))
    repeated = solved.unionByName(copied)
    # texts with copies go whole, below; the cuts are those of texts that occur once
    moved = F.transform("runs", lambda r: F.struct((r["s"] + F.col("lo")).alias("s"), (r["e"] + F.col("lo")).alias("e")))
    hits = places.filter("copies = 1").join(repeated, ["h", "digest"]).select("_key", "rep", moved.alias("runs"))
    cuts = materialize(hits.groupBy("_key", "rep").agg(F.flatten(F.collect_list("runs")).alias("runs")), "cuts")
    here = keyed["_key"].eqNullSafe(F.col("c_key")) & keyed["_id"].eqNullSafe(F.col("rep"))
    cut = keyed.join(cuts.withColumnRenamed("_key", "c_key"), here).select("_id", "text", "runs").mapInArrow(_cut_texts(length), f"_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
    rest = texts.select("_key", "copies").join(cuts.select("_key"), "_key", "left_anti")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole = keyed.select(F.col("_id"), "_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha")).join(rest, "_key")
    empty = F.lit("").cast("binary")
    whole = whole.select("_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"), F.when(gone, empty).alias("kept"), F.when(gone, F.sha2(empty, 256)).otherwise(F.col("_sha")).alias("kept_sha256"))
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256))
    return cut.unionByName(whole).withColumnRenamed("_id", id_col)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP9_SQL = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS m FROM (SELECT doc_id, x, unnest(range(1, n - 398)) AS i FROM b WHERE n >= 400)
), hit AS (
  SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)
), run AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit)
), span AS (
  SELECT doc_id, min(i) AS s, max(i) + 399 AS e FROM run GROUP BY doc_id, k
), cut AS (
  SELECT span.doc_id, s, e, x, n, substr(x, 2 * e + 1, 2 * (coalesce(lead(s) OVER (PARTITION BY span.doc_id ORDER BY s), n + 1) - e - 1)) AS after FROM span JOIN b ON b.doc_id = span.doc_id
), kept AS (
  SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans, substr(any_value(x), 1, 2 * (min(s) - 1)) || string_agg(after, '' ORDER BY s) AS x FROM cut GROUP BY doc_id
)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(kept.n_removed, 0)::BIGINT AS n_removed, coalesce(kept.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256
FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id
"""
