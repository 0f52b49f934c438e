"""Similarity join of documents on word shingles, by PartEnum signatures.

Two sets of sizes m and n with Jaccard similarity of 4/5 or more differ in
k = (m + n) / 9 elements at most. PartEnum partitions the domain of shingle
hashes twice: into first-level partitions, as many as fit the size band, and each
of these into three second-level parts. Of each first-level partition all subsets of two
parts are enumerated; a subset with what the set holds in it is one signature.
An element in which two sets differ lies in one part and spoils the two subsets
with that part, so similar sets agree in all but 2k signatures of either. By the
pigeonhole any 2k + 1 signatures of one hold one that the other has; if all
signatures are put in one order, the first 2k + 1 of either are enough. The order, an
extra filter, puts rare ones first, so what many documents share, a passage or a
licence, signs only for sets that consist of it.

Bands double in size; a set within 5/4 of the lower edge of its band also
signs under the band below, where its smaller partners are. Sets of less than
`SINGLE` elements have one part per element and subsets of one. A set with 2k signatures or
fewer cannot sign; then the whole table signs again under another seed, and in the
end with one part per element, so no link is lost.

Signatures travel as packed arrays, once to the bucket of their hash, where they are
counted and those that occur once fall out, and once, with their counts, back to
their set, where the first 2k + 1 are chosen. On both ways a number within a block of sets stands
for the set, so their bytes don't depend on the number of buckets. Signatures that the very same
sets share become one. Sets that share one are candidates; their similarity is
computed on whole sets. Equal sets are one node from the start, and links are
sought until components are known:

1. in each of a few rounds, each set with the best two, not yet tried, of the most
   central sets of other components in its signatures;
2. then, in signatures that still span components, the sets outside the largest component with
   all others, where the sizes and the histogram of their elements, a bound
   that loses none, allow a link. Sets of the largest component don't meet each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import BROADCAST_ROWS, WordHashes, broadcast_if_small, materialize, mix64, release, table, window_hashes

SHINGLE = 5
SINGLE = 64
#: Mean elements in a first-level partition at the upper edge of a band.
FILL = 4.5
#: Second-level parts of a first-level partition; a subset leaves one of them out.
SECOND = 3
#: Features that a bucket holds in the mean, and rows of one signature that a task of a join reads at most.
BUCKET, SPLIT = 1_000_000, 20_000


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words where there are fewer."""
    words = [] if not text else text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(window_hashes(hashes.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def fingerprint(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def most_different(m: int, n: int) -> int:
    """Elements in which sets of these sizes and similarity 4/5 can differ."""
    return (m + n) // 9


def _band(n: int) -> int:
    return n.bit_length() - 1


def _firsts(band: int) -> int:
    return int(np.ceil(2 ** (band + 1) / FILL))


def subset_signatures(found: np.ndarray, band: int, seed: int) -> np.ndarray:
    """All signatures of a set in a band's partition: a hash for each subset of two second-level parts that isn't empty."""
    salt = mix64(np.array([seed * 1000 + band + 1], np.uint64))[0]
    place = mix64(found ^ salt) % np.uint64(SECOND * _firsts(band))
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    at = place[starts]
    content = mix64(np.add.reduceat(mix64(found[order] + salt), starts) ^ mix64(at + salt))
    first = at // np.uint64(SECOND)
    row = np.cumsum(np.concatenate([[False], first[1:] != first[:-1]]))
    grid = np.zeros((int(row[-1]) + 1, SECOND), np.uint64)
    grid[row, (at % np.uint64(SECOND)).astype(np.int64)] = content
    out = []
    for left_out in range(SECOND):
        one, two = grid[:, (left_out + 1) % SECOND], grid[:, (left_out + 2) % SECOND]
        held = (one | two) != 0
        out.append(mix64(one[held] * np.uint64(0x9E3779B97F4A7C15) + two[held] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(left_out + 1)))
    return np.concatenate(out)


def schemes(found: np.ndarray, seed: int) -> list[tuple[np.ndarray, int]] | None:
    """(signatures, slack) under each partition that a set signs by; in the common order all but the last `slack` are needed.

    None where signatures under this seed are too few. seed < 0: one part per element.
    """
    n = len(found)
    if n < 4:  # similar sets of three elements or less are equal
        return []
    single = lambda: (mix64(found ^ np.uint64(0x51)), (4 * n + 4) // 5 - 1)
    if seed < 0 or n < SINGLE:
        return [single()]
    band = _band(n)
    out = []

    def under(band, k):
        parts = subset_signatures(found, band, seed)
        out.append((parts, len(parts) - (SECOND - 1) * k - 1))

    under(band, most_different(n, n * 5 // 4))
    # partners below the band have 4/5 of n elements to its edge
    edge = 2**band
    if -(-4 * n // 5) < edge:
        if edge <= SINGLE:
            out.append(single())
        else:
            under(band - 1, most_different(n, edge - 1))
    return None if any(slack < 0 for _, slack in out) else out


def _describe(batches):
    """Rows with text -> (_id, text_key, n_shingles, fp); fp is null for an empty set."""
    hashes = WordHashes()
    for batch in batches:
        n, fp = [], []
        for text in batch.column("text"):
            found = shingles(text.as_py(), hashes)
            n.append(len(found))
            fp.append(fingerprint(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(fp, pa.int64())], names=["_id", "text_key", "n_shingles", "fp"])


_PARTS = "bucket int, block long, parts binary, units binary, fps binary, codes binary"
#: Bits of a set's unit, its number in a block, and of a block's number in its task.
UNIT_BITS, BLOCK_BITS = 16, 24


def _pack_units(units: np.ndarray) -> bytes:
    """Ascending uint16 as differences, low bytes first, then the high ones, which are nearly all 0 and compress."""
    return np.diff(units, prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack_units(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(2, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint16).ravel(), dtype=np.uint16)


def _sign(seed: int, bits: int, flush=1 << 20, units=60_000):
    """Rows with text -> rows of _PARTS: signatures of a block of many sets, by bucket of the signature, and a row of the block's sets.

    Bucket and part are the first `bits` and the next 32 bits of the signature's hash. A unit (uint16) is a set under one of its schemes; it leads
    to fps and codes in the row of the block, whose bucket is null; a code is 2 * slack + place among the set's schemes. bucket -1: a set couldn't sign.
    """

    def batch_of(*cols):
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "block", "parts", "units", "fps", "codes"])

    def packed(block, parts, fps, codes):
        part = np.concatenate(parts)
        unit = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        bucket = (part >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        part, unit = ((part[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), unit[order]
        values, starts = np.unique(bucket[order], return_index=True)
        n = len(values)
        own = [x.tobytes() for x in np.split(part, starts[1:])], [_pack_units(x) for x in np.split(unit, starts[1:])]
        sets = np.array(fps, np.int64).tobytes(), np.array(codes, np.int32).tobytes()
        return batch_of([*values.tolist(), None], [block] * (n + 1), [*own[0], None], [*own[1], None], [None] * n + [sets[0]], [None] * n + [sets[1]])

    def run(batches):
        hashes, seen = WordHashes(), set()
        block = TaskContext.get().partitionId() << BLOCK_BITS
        parts, fps, codes, size = [], [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), hashes)
                fp = fingerprint(found)
                if fp in seen or len(found) < 4:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(fp)
                own = schemes(found, seed)
                if own is None:
                    yield batch_of([-1], *[[None]] * 5)
                    continue
                for place, (x, slack) in enumerate(own):
                    parts.append(x), fps.append(fp), codes.append(2 * slack + place)
                    size += len(x)
                if size >= flush or len(parts) >= units:
                    yield packed(block, parts, fps, codes)
                    block += 1
                    parts, fps, codes, size = [], [], [], 0
        if size:
            yield packed(block, parts, fps, codes)

    return run


_SHARED = "block long, packed binary"


def _per_key(solve, key, columns):
    """A mapInArrow function for rows ordered by key: solve gets the columns' values of one key at a time; key -1 gets its own call."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            cols = [batch.column(c) for c in columns]
            for i, own in enumerate(batch.column(key).to_pylist()):
                if held and own != at:
                    yield solve(at, held)
                    held = []
                at = own
                held.append([c[i].as_py() for c in cols])
        if held:
            yield solve(at, held)

    return run


def _count_parts():
    """_PARTS of a bucket -> _SHARED: signatures that occur twice or more with their counts, by block of the set."""

    def solve(bucket, rows):
        if bucket < 0:
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([b""], pa.binary())], names=["block", "packed"])
        part = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        unit = np.concatenate([_unpack_units(r[2]) for r in rows])
        block = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) // 4 for r in rows])
        rows.clear()
        order = np.argsort(part)
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(part)]]))
        sets = np.repeat(sizes, sizes)
        keep = sets > 1
        order = order[keep]
        return _by_block(block[order], unit[order], part[keep].astype(np.int64) | (bucket << 32), sets[keep])

    return _per_key(solve, "bucket", ["block", "parts", "units"])


def _by_block(block, unit, sig, sets) -> pa.RecordBatch:
    """_SHARED of signatures with their counts, by block of the set: all signatures, then all counts, then all units."""
    order = np.argsort(block, kind="stable")
    values, starts = np.unique(block[order], return_index=True)
    cols = [np.split(x[order], starts[1:]) for x in (sig.astype(np.int64), np.minimum(sets, 2**31 - 1).astype(np.int32), unit.astype(np.uint16))]
    blobs = [b"".join(x.tobytes() for x in own) for own in zip(*cols, strict=True)] if len(values) else []
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "packed"])


def _unpack(batches):
    """_PARTS -> rows (sig, block, unit)."""
    for batch in batches:
        for bucket, block, part, units in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "parts", "units")], strict=True):
            sig = np.frombuffer(part, np.uint32).astype(np.int64) | (bucket << 32)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.full(len(sig), block, np.int64)), pa.array(_unpack_units(units).astype(np.int32))], names=["sig", "block", "unit"])


def _count_hot(parts: DataFrame, hot: DataFrame) -> DataFrame:
    """What _count_parts gives, of the hot buckets (bucket, salts): counted with partial sums, the counts joined back by signature and salt.

    No task holds all sets of a signature.
    """
    known = broadcast_if_small(hot)
    bucket = F.shiftright("sig", 32).cast("int")
    held = parts.join(known, "bucket", "left_semi").mapInArrow(_unpack, "sig long, block long, unit int")
    counts = held.groupBy("sig").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").withColumn("bucket", bucket).join(known, "bucket")
    counts = counts.select("sig", "sets", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = held.withColumn("bucket", bucket).join(known, "bucket").withColumn("salt", F.pmod(F.xxhash64("block", "unit"), F.col("salts")).cast("int"))

    def pack(batches):
        for batch in batches:
            yield _by_block(*[batch.column(c).to_numpy() for c in ("block", "unit", "sig", "sets")])

    return salted.join(counts, ["sig", "salt"]).select("block", "unit", "sig", "sets").mapInArrow(pack, _SHARED)


def _list_units(batches):
    """Rows of blocks -> rows (fp, code, at); at is block and unit in one number."""
    for batch in batches:
        for block, fps, codes in zip(*[batch.column(c).to_pylist() for c in ("block", "fps", "codes")], strict=True):
            fp, code = np.frombuffer(fps, np.int64), np.frombuffer(codes, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(code), pa.array(np.arange(len(fp)) + (block << UNIT_BITS))], names=["fp", "code", "at"])


def _repeated_units(blocks: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(block, gone) of the units whose set has signed elsewhere too, all but its first; None if there are none. The second frame is a scratch table."""
    units = blocks.mapInArrow(_list_units, "fp long, code int, at long")
    twice = materialize(units.groupBy("fp", "code").agg(F.min("at").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "signed-twice")
    if twice.isEmpty():
        return None, twice
    more = units.join(broadcast_if_small(twice), ["fp", "code"]).filter("at > stays")
    return more.groupBy(F.shiftright("at", UNIT_BITS).alias("block")).agg(F.collect_list(F.col("at").bitwiseAND((1 << UNIT_BITS) - 1).cast("int")).alias("gone")), twice


_GROUPS = "sig long, fp long, central long"


def _choose_signatures():
    """_SHARED of a block, with its row of sets and its units to leave out -> (sig, fp, central): each set's signatures that other sets have as parts.

    central adds up how many sets share the set's parts.
    """

    def rows_of(sig, fp, central):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sig, fp, central)], names=["sig", "fp", "central"])

    def solve(block, rows):
        if block < 0:
            return rows_of([0], [None], [None])
        packs = [r[0] for r in rows if r[0] is not None]
        cols = [[], [], []]
        for x in packs:
            n = len(x) // 14
            for col, kind, at in zip(cols, (np.int64, np.int32, np.uint16), (0, 8 * n, 12 * n), strict=True):
                col.append(np.frombuffer(x, kind, n, at))
        if not packs:
            return rows_of([], [], [])
        sig, sets, unit = map(np.concatenate, cols)
        fps, codes = next((np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int32)) for r in rows if r[1] is not None)
        gone = [g for r in rows for g in r[3] or []]
        if gone:
            stays = ~np.isin(unit, np.array(gone, np.uint16))
            sig, sets, unit = sig[stays], sets[stays], unit[stays]
        if not len(sig):
            return rows_of([], [], [])
        order = np.lexsort((sig, sets, unit))
        sig, sets, unit = sig[order], sets[order].astype(np.int64), unit[order]
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(unit)]]))
        rank = np.arange(len(unit)) - np.repeat(starts, sizes)
        keep = rank < np.repeat(sizes - (codes[unit[starts]] >> 1), sizes)
        central = np.repeat(np.add.reduceat(sets, starts), sizes)[keep]
        sig, fp = sig[keep], fps[unit[keep]]
        # a set has a signature once, under whichever schemes
        order = np.lexsort((-central, fp, sig))
        sig, fp, central = sig[order], fp[order], central[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])])[: len(sig)]
        return rows_of(sig[new], fp[new], central[new])

    return _per_key(solve, "block", ["packed", "fps", "codes", "gone"])


def shared_signatures(rows: DataFrame, elements: int, *, bucket=None, hot=4, seeds=4) -> DataFrame:
    """(sig, fp, central, size, weight) of the signatures that different sets share.

    elements is the sum of all sets' sizes, from which the number of buckets follows.
    Buckets that hold more than `hot` times the mean, those of signatures that very many sets have, are counted in parts.
    Rows that repeat a set add to the counts, which give an order only, and sign once.
    Of signatures with the same sets one stays, with their number as weight; size is its number of sets.
    """
    each = bucket or BUCKET
    bits = max(3, int(np.ceil(np.log2(max(1, elements / each)))))
    spread = lambda df, key: df.repartition(1 << bits, key).sortWithinPartitions(key)
    for seed in [*range(seeds), -1]:
        signs = materialize(rows.select("text").mapInArrow(_sign(seed, bits), _PARTS), "signature-parts")
        parts = signs.filter("bucket is not null").select("bucket", "block", "parts", "units")
        blocks = signs.filter("fps is not null").select("block", "fps", "codes")
        sizes = parts.groupBy("bucket").agg(F.sum(F.octet_length("parts") / 4).alias("held"))
        large = materialize(sizes.filter((F.col("bucket") >= 0) & (F.col("held") > hot * each)).select("bucket", F.ceil(F.col("held") / each).cast("int").alias("salts")), "hot-buckets")
        if large.isEmpty():
            counted = spread(parts, "bucket").mapInArrow(_count_parts(), _SHARED)
        else:
            cold = parts.join(broadcast_if_small(large), "bucket", "left_anti")
            counted = spread(cold, "bucket").mapInArrow(_count_parts(), _SHARED).unionByName(_count_hot(parts, large))
        gone, twice = _repeated_units(blocks)
        known = counted.unionByName(blocks, allowMissingColumns=True)
        known = known.unionByName(gone, allowMissingColumns=True) if gone is not None else known.withColumn("gone", F.lit(None).cast("array<int>"))
        signed = materialize(spread(known, "block").mapInArrow(_choose_signatures(), _GROUPS), "signatures")
        release(signs, large, twice)
        if signed.filter("fp is null").isEmpty():
            who = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
            sets = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *who).filter("size > 1")
            kept = sets.groupBy("size", "x0", "x1").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight")).select("sig", "size", "weight")
            found = materialize(signed.join(kept, "sig"), "shared-signatures")
            release(signed)
            return found
        release(signed)
    raise AssertionError("every set signs with one part per element")


def _meet(rows: DataFrame, each: DataFrame) -> DataFrame:
    """rows (with sig, size, fp) joined with each, a row per (sig, size); rows of a large signature are dealt over several tasks."""
    salts = F.ceil(F.col("size") / SPLIT).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), salts).cast("int"))
    right = each.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size")
    return left.join(right, ["sig", "salt"]).drop("salt")


def histogram(found: np.ndarray) -> bytes:
    """Counts of the elements by their first bits, half to as many bins as elements; one bin of 0, which bounds nothing, if a count passes 255."""
    bits = max(6, len(found).bit_length() - 1)
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\0"


def _load_sets(batches):
    """Rows with text and the wanted fp -> (fp, n, hist, elements), where the text's set has that fp."""
    hashes = WordHashes()
    for batch in batches:
        fps, ns, hists, blobs = [], [], [], []
        for text, wanted in zip(batch.column("text"), batch.column("fp").to_pylist(), strict=True):
            found = shingles(text.as_py(), hashes)
            if fingerprint(found) == wanted:
                fps.append(wanted), ns.append(len(found)), blobs.append(found.tobytes())
                hists.append(histogram(found))
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(hists, pa.binary()), pa.array(blobs, pa.binary())], names=["fp", "n", "hist", "elements"])


def similar(m: int, n: int, common: int) -> bool:
    return 5 * common >= 4 * (m + n - common)


def _verify(batches):
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            keep.append(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([v for v, k in zip(b, keep, strict=True) if k], pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), the similar ones."""
    left = sets.select(F.col("fp").alias("a"), F.col("elements").alias("xs"))
    right = sets.select(F.col("fp").alias("b"), F.col("elements").alias("ys"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long")


_MEMBER = "array<struct<fp:bigint,component:bigint,n:bigint,hist:binary,first:array<bigint>>>"
#: Of a set's signatures that span components, so many, the smallest, travel with it.
FIRST = 8


def _side(members: pa.StructArray) -> tuple:
    """fp, component and n of a block's members, FIRST of their signatures, and the bins of each member's histogram in one array with their ends."""
    hist = members.field("hist")
    ends = np.frombuffer(hist.buffers()[1], np.int32)[hist.offset : hist.offset + len(hist) + 1]
    bins = np.frombuffer(hist.buffers()[2], np.uint8)
    first = np.full((len(members), FIRST), np.iinfo(np.int64).max)
    own = members.field("first")
    sizes = np.diff(own.offsets.to_numpy())
    first[np.arange(FIRST) < sizes[:, None]] = own.flatten().to_numpy(zero_copy_only=False)
    return *[members.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "component", "n")], first, bins, ends


def _folded(bins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Histograms of different widths, all powers of two, as rows of `width` sums."""
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int32)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        out[own] = bins[ends[own][:, None] + np.arange(size)].reshape(len(own), width, size // width).sum(axis=2, dtype=np.int32)
    return out


def _possible(rows=256, known=200_000):
    """Members of a signature (left block, right block) -> pairs across components that their bounds allow.

    right is null where a block meets itself. A pair is left to a smaller signature of both where the
    first ones that travel with the sets show one, else given once, as far as the last `known` pairs of this task tell.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for sig, left, right in zip(batch.column("sig").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                one = _side(left.values)
                two = one if right.values is None else _side(right.values)
                width = int(min(np.diff(one[5]).min(), np.diff(two[5]).min()))
                hists = None
                for i in range(0, len(one[0]), rows):
                    cut = slice(i, i + rows)
                    ok = one[1][cut, None] != two[1][None]
                    most = (one[2][cut, None] + two[2][None]) // 9
                    ok &= np.abs(one[2][cut, None] - two[2][None]) <= most
                    if two is one:
                        ok &= one[0][cut, None] < two[0][None]
                    x, y = np.nonzero(ok)
                    if len(x) and hists is None:
                        hists = [_folded(*side[4:], width) for side in (one, two)]
                    step = max(1, (1 << 22) // width)
                    for j in range(0, len(x), step):
                        u, v = x[j : j + step], y[j : j + step]
                        near = np.abs(hists[0][cut][u] - hists[1][v]).sum(axis=1) <= most[u, v]
                        u, v = u[near], v[near]
                        mine = one[3][cut][u]
                        here = ~((mine[:, :, None] == two[3][v][:, None, :]) & (mine < sig)[:, :, None]).any(axis=(1, 2))
                        p, q = one[0][cut][u[here]], two[0][v[here]]
                        new = [pair for pair in zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True) if pair not in seen]
                        if new:
                            if len(seen) > known:
                                seen.clear()
                            seen.update(new)
                            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.int64()), pa.array([b for _, b in new], pa.int64())], names=["a", "b"])

    return run


def _remaining_pairs(groups: DataFrame, labels: DataFrame, sets: DataFrame, block=500) -> DataFrame:
    """All pairs that share a signature across components and pass the bounds.

    Members of a signature are dealt into blocks of about `block`, those of its largest
    component into blocks of their own, which meet the others but not each
    other; no row and no task holds more than two blocks at a time. Up to `block` members
    are one block.
    """
    named = groups.select("sig", "fp", "size").join(labels, "fp")
    by_component = named.groupBy("sig", "size", "component").agg(F.count(F.lit(1)).alias("k"))
    cross = by_component.groupBy("sig", "size").agg(F.max(F.struct("k", "component")).alias("main")).filter(F.col("main.k") < F.col("size"))
    spanning = _meet(named, cross)
    first = spanning.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST).alias("first"))
    members = spanning.join(sets.select("fp", "n", "hist").join(first, "fp"), "fp")
    inner, outer = (F.when(F.col("size") <= block, few).otherwise(F.ceil(x / block)).cast("int") for x, few in ((F.col("main.k"), 0), (F.col("size") - F.col("main.k"), 1)))
    own = lambda blocks: F.pmod(F.xxhash64("fp"), F.greatest(blocks, F.lit(1))).cast("int")
    dealt = members.select("sig", inner.alias("inner"), outer.alias("outer"), F.when((F.col("component") == F.col("main.component")) & (inner > 0), own(inner)).otherwise(inner + own(outer)).alias("block"), F.struct("fp", "component", "n", "hist", "first").alias("member"))
    lists = materialize(dealt.groupBy("sig", "block", "inner", "outer").agg(F.collect_list("member").alias("members")), "blocks")
    rest = lists.filter("block >= inner")
    alone = rest.select("sig", F.col("members").alias("left"), F.lit(None).cast(_MEMBER).alias("right"))
    others = F.filter(F.sequence(F.lit(0), F.col("inner") + F.col("outer") - 1), lambda j: (j < F.col("inner")) | (j > F.col("block")))
    one = rest.select("sig", F.col("members").alias("left"), F.explode(others).alias("block"))
    two = lists.select("sig", "block", F.col("members").alias("right"))
    apart = one.join(two, ["sig", "block"]).select("sig", "left", "right")
    return alone.unionByName(apart).mapInArrow(_possible(), "a long, b long").distinct()


def _best_pairs(groups: DataFrame, labels: DataFrame | None, tested: DataFrame | None, each: int = 2) -> DataFrame:
    """Untested pairs (a, b): each set with up to `each` central sets of other components that share a signature.

    In a signature only its most central set and the most central one of
    another component are partners, so pairs grow with signatures, not with their squares.
    """
    named = groups.join(labels, "fp") if labels is not None else groups.withColumn("component", F.col("fp"))
    top = F.max(F.struct("central", "fp", "component"))
    first = named.groupBy("sig", "size").agg(top.alias("one"))
    with_first = _meet(named, first)
    second = with_first.filter("component <> one.component").groupBy("sig", "size").agg(top.alias("two"))
    chosen = _meet(with_first, second).withColumn("to", F.when(F.col("component") != F.col("one.component"), F.col("one")).otherwise(F.col("two")))
    pairs = chosen.groupBy("fp", F.col("to.fp").alias("other")).agg(F.max("to.central").alias("central"), F.sum("weight").alias("shared"))
    pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"), "fp", "central", "shared")
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("central"), F.desc("shared"), "a", "b")))
    return ranked.filter(F.col("rank") <= each).select("a", "b").distinct()


def _without_copies(rows: DataFrame, described: DataFrame) -> DataFrame:
    """rows without most of those that repeat the set of another; all rows where such are too many to broadcast."""
    pick = F.xxhash64("_id", "text_key")
    held = described.filter("fp is not null")
    copied = materialize(held.groupBy("fp").agg(F.min(pick).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    if copied.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0] > BROADCAST_ROWS:
        return rows
    copies = held.join(F.broadcast(copied), "fp").filter(pick != F.col("stays")).select(F.col("_id").alias("c_id"), F.col("text_key").alias("c_key"))
    copies = materialize(copies.distinct(), "copies")
    same = rows["_id"].eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_key"))
    return rows.join(F.broadcast(copies), same, "left_anti")


def similar_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", rounds=2) -> DataFrame:
    """A row per row of docs: id_col, n_shingles, component_id, class_key, text_key.

    Documents link when the Jaccard similarity of their sets of five-word
    shingles is 4/5 or more, exactly; component_id is the smallest id reachable
    by links. Null, empty and wordless texts have no shingles and stand alone, so do
    rows that repeat their id. A text of fewer than five words is one shingle. Null
    ids take part and count as larger than all others. An empty table gives
    an empty result; other columns are ignored. Words and sets are compared by
    64-bit hashes. class_key tells components apart where ids cannot, null for texts
    without shingles; text_key is Spark's xxhash64 of the text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    described = materialize(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe, f"_id {id_type}, text_key long, n_shingles long, fp long"), "shingle-sets")
    first = described.filter("fp is not null").groupBy("fp").agg(F.min("_id").alias("_id"))
    elements = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    groups = shared_signatures(_without_copies(rows, described), elements)
    if groups.isEmpty():
        labels = None
    else:
        wanted = materialize(first.join(groups.select("fp").distinct(), "fp").withColumnRenamed("_id", "w_id"), "wanted")
        loaded = rows.join(broadcast_if_small(wanted), rows["_id"].eqNullSafe(F.col("w_id"))).select("text", "fp").mapInArrow(_load_sets, "fp long, n long, hist binary, elements binary")
        sets = materialize(loaded.dropDuplicates(["fp"]), "elements")
        everyone = sets.select("fp")

        def named(edges):
            found = connected_components(edges).withColumnRenamed("node", "fp")
            return everyone.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))

        labels, tested, edges = None, None, None
        for _ in range(rounds):
            more = materialize(_best_pairs(groups, labels, tested), "pairs")
            tested = more if tested is None else tested.union(more)
            new = materialize(verified(more, sets), "links")
            if new.isEmpty():
                break
            edges = new if edges is None else edges.union(new)
            old, labels = labels, materialize(named(edges), "labels")
            release(old)
        if labels is None:
            labels = everyone.withColumn("component", F.col("fp"))
        rest = _remaining_pairs(groups, labels, sets)
        if tested is not None:
            rest = rest.join(tested, ["a", "b"], "left_anti")
        new = materialize(verified(rest, sets), "links")
        if not new.isEmpty():
            labels = named(new if edges is None else edges.union(new))
    if labels is None:
        nodes = first.select("fp", F.col("fp").alias("class_key"), F.col("_id").alias("component_id"))
    else:
        classed = first.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "_id")
        smallest = classed.groupBy("component").agg(F.min("_id").alias("component_id"))
        nodes = classed.join(smallest, "component").select("fp", F.col("component").alias("class_key"), "component_id")
    found = described.join(nodes, "fp", "left")
    return found.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"), "class_key", "text_key")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * c.k >= 80 * (na.n + nb.n - c.k)
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
