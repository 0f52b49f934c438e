import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import suffix_dedup as sd


def brute(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((d, len(r), int(gone.sum()), len(sd._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_two_stage_sort_and_repeats():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.randint(3, 12)
        alphabet = rng.choice([b"ab", b"abc", b"abcdefgh"])
        chunks = list({bytes(rng.choice(alphabet) for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 6))})
        x = np.concatenate([np.append(np.frombuffer(c, np.uint8) + 1, 0) for c in chunks]).astype(np.uint8)
        raw = x.tobytes()
        assert sd.two_stage_suffixes(x, 10**6).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        seen = Counter(c[i : i + length] for c in chunks for i in range(len(c) - length + 1))
        assert [a.tolist() for a in sd.repeated_starts(chunks, length)] == [[seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in chunks]


@pytest.mark.parametrize("bits", [4, 21])
def test_equal_windows_have_equal_anchors(bits):
    rng = random.Random(2)
    common = bytes(rng.randrange(97, 100) for _ in range(60))
    hashes = sd.GramHashes(7)
    of = []
    for _ in range(2):
        raw = bytes(rng.randrange(97, 100) for _ in range(rng.randint(0, 40))) + common + bytes(rng.randrange(97, 100) for _ in range(30))
        at = raw.index(common)
        found = {s: h for h, lo, hi, _ in sd.anchors(raw, 20, hashes, bits) for s in range(lo, hi + 1)}
        assert sorted(found) == list(range(len(raw) - 19))
        of.append([found[at + k] for k in range(41)])
    assert of[0] == of[1]


def documents():
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 50), (103, "x" * 50), (104, "y" * 400), (105, "short"), (106, "short"), (7, docs[7][1]), (107, "q" * 11), (108, "abcab" * 30), (109, "mnopqrstuvwx" * 2 + "k")]
    return docs + [(200 + i, docs[i][1][:20] + "zz" + docs[i + 1][1][5:]) for i in range(30)]


@pytest.mark.parametrize("classes", [400, 2])
def test_removal(spark, classes):
    docs = documents()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, copies int").repartition(3)
    out = sd.remove_repeats(df, length=12, gram=5, classes=classes)
    got = sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(docs, 12)
    for r in out.filter("n_removed > 0").collect():
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert sd.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(150_000))
    docs = [(1, long), (2, "k" + long[50_000:50_600] + "m"), (None, "null id"), (4, "i" * 3000)]
    out = sd.remove_repeats(spark.createDataFrame(docs, schema))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got == {1: (600, 1), 2: (600, 1), None: (0, 0), 4: (3000, 1)}


def test_one_character_makes_few_chunks():
    found = sd.anchors(b"a" * 100_000, 400, sd.GramHashes(128))
    assert len(found) == 250 and all(own for *_, own in found)
