"""What several corpus operators need: shared scratch tables, text views and hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN_UP: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing, a temporary folder serves a local master; on a
    cluster that would be a machine-local folder, so it is an error there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_quillframe_folder", None):
        spark._quillframe_folder = "file://" + tempfile.mkdtemp(prefix="quillframe-")
    return spark._quillframe_folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: nothing can be deleted through it
        pass


@atexit.register
def _delete_all() -> None:
    for spark, path in _CLEAN_UP:
        _delete(spark, path)


#: Bytes of a scratch table's row group, what a task holds while it writes or reads one.
ROW_GROUP = 32 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return it as read from there.

    This cuts the lineage in a way that outlives executors: the files are
    committed task by task and any executor can read them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _CLEAN_UP.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._quillframe_path = path
    return found


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote, now that nothing reads them any more; other frames and None are left alone."""
    for df in tables:
        path = getattr(df, "_quillframe_path", None)
        if path:
            _delete(df.sparkSession, path)
            _CLEAN_UP[:] = [x for x in _CLEAN_UP if x[1] != path]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of narrow keys up to which a side of a join is broadcast.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where a count shows that it has at most limit rows; else it joins by shuffle.

    For sides of a few numbers a row; df is counted, so it should be read from a table.
    """
    return F.broadcast(df) if df.count() <= limit else df


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id written as text, the number that splits training from held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64; wraps without a warning."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept between documents up to a bound."""

    def __init__(self, limit=400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_BASE = 0x9E3779B97F4A7C15
_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(sign: int, n: int) -> np.ndarray:
    """_BASE ** (sign * i) modulo 2**64 for i below n; kept, and grown by need."""
    if len(_POWERS[sign]) < n:
        table = np.full(max(n, 1 << 14), _BASE if sign > 0 else pow(_BASE, -1, 1 << 64), np.uint64)
        table[0] = 1
        _POWERS[sign] = np.multiply.accumulate(table)
    return _POWERS[sign][:n]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive words, from differences of prefix sums of a polynomial."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(1, len(words)), out=sums[1:])
    out = (sums[n:] - sums[:-n]) * _powers(-1, len(words) - n + 1)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))
