import hashlib
import re

from pyspark.sql import functions as F

from quillframe.llm.exact_dedup import exact_groups

ROWS = [(5, "a  b"), (3, "a\t\nb"), (4, "a b "), (9, None), (8, ""), (7, "x" * 50_000), (2, "x" * 50_000), (6, "a b"), (3, "a b"), (None, "n"), (None, "n")]
SCHEMA = "doc_id long, text string, _digest string, kept boolean"


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", True) for i, t in rows], SCHEMA)


def check(spark, rows, **options):
    out = exact_groups(frame(spark, rows).repartition(3), **options).collect()
    texts = brute(rows)
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in out) == len(texts)
    for t, ids in texts.items():
        keep = min((i for i in ids if i is not None), default=None)
        mine = [r for r in out if r["keep_id"] == keep and r["group_size"] == len(ids) and r["doc_id"] in ids]
        assert len(mine) >= len(ids)
    return out


def test_groups(spark):
    out = check(spark, ROWS)
    digests = {r["text_digest"] for r in out}
    assert digests == {hashlib.sha256(t.encode()).hexdigest() for t in brute(ROWS)}


def test_colliding_digests_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    out = check(spark, rows, digest=lambda c: F.crc32(c.cast("binary")) % 3, salts=4)
    assert {r["doc_id"]: r["keep_id"] for r in out} == {i: i % 7 for i in range(60)}


def test_hot_group(spark):
    rows = [(i, "same") for i in range(500)] + [(1000 + i, str(i)) for i in range(100)]
    out = check(spark, rows, salts=8)
    assert {r["group_size"] for r in out} == {500, 1}


def test_empty(spark):
    assert exact_groups(frame(spark, [])).count() == 0
