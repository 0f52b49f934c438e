import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quillframe.llm import ngram_join as nj
from quillframe.llm._components import connected_components


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, k in common.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def varied(seed, sizes, groups=40, copies=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        docs.append(base)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                k = rng.randrange(len(w) + 1)
                r = rng.random()
                if r < 0.4:
                    w[k : k + 1] = [rng.choice(vocabulary)]
                elif r < 0.7:
                    w[k:k] = [rng.choice(vocabulary)]
                else:
                    w = w[: max(1, len(w) - rng.randint(1, 1 + len(w) // 20))]
            docs.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, fp long, _id string")
    return nj.similar_documents(df.repartition(3), **options).collect()


@pytest.mark.parametrize(("seed", "sizes"), [(1, [3, 6, 8, 10, 20, 50]), (2, [60, 66, 70, 90, 130, 200, 700])])
def test_components(spark, seed, sizes):
    docs = varied(seed, sizes) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "é É"), (1006, "é é")]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, docs)} == brute(docs)


def test_fallback_to_one_part_per_element(spark, monkeypatch):
    docs = varied(3, [70, 100, 150], groups=8)
    monkeypatch.setattr(nj, "subset_signatures", lambda found, band, seed: found[:3])
    assert nj.schemes(np.arange(100, dtype=np.uint64), 0) is None
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, docs)} == brute(docs)


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9, 30, 63, 64, 70, 79, 127, 128, 150, 300, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, nj.most_different(n, n) // 2 + 1)
            add = rng.integers(0, max(0, n // 4 - drop * 5 // 4) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
            if nj.similar(len(a), len(b), len(np.intersect1d(a, b))) and not np.array_equal(a, b):
                kept = [{x for parts, slack in nj.schemes(s, 0) for x in np.sort(parts)[: len(parts) - slack].tolist()} for s in (a, b)]
                assert kept[0] & kept[1]


def test_repeated_and_null_ids(spark):
    t = " ".join(f"u{i}" for i in range(40))
    rows = run(spark, [(1, t), (1, t), (None, t + " z"), (None, "alone here"), (2, None), (2, None)])
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("1", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("None", "1"), ("None", "None")]


def test_blocks_of_a_wide_signature(spark, monkeypatch):
    # histograms of 64 and of 128 bins that agree when folded
    hist = lambda i: bytearray(np.full(64 * (1 + i % 2), (i % 3 + 1) * 2 // (1 + i % 2), np.uint8).tobytes())
    sets = spark.createDataFrame([(i, 10, hist(i), bytearray()) for i in range(30)], "fp long, n long, hist binary, elements binary")
    groups = spark.createDataFrame([(g, i, 30) for g in (7, 8) for i in range(30)], "sig long, fp long, size long")
    for parts in (2, 5):
        labels = spark.createDataFrame([(i, min(i % parts, i // 10)) for i in range(30)], "fp long, component long")
        of = lambda i: min(i % parts, i // 10)
        want = {(a, b) for a in range(30) for b in range(a + 1, 30) if of(a) != of(b) and a % 3 == b % 3}
        for block, split in ((4, 3), (1000, 20_000)):
            monkeypatch.setattr(nj, "SPLIT", split)
            assert {tuple(r) for r in nj._remaining_pairs(groups, labels, sets, block=block).collect()} == want


def test_large_signatures_are_dealt_over_tasks(spark, monkeypatch):
    docs = varied(5, [30, 80, 140], groups=6, copies=12)
    monkeypatch.setattr(nj, "SPLIT", 2)
    monkeypatch.setattr(nj, "BUCKET", 500)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, docs, rounds=1)} == brute(docs)


def test_hot_buckets_are_counted_in_parts(spark):
    """Every set shares one passage, so its signatures are in most sets; counts in salted parts are those of whole buckets."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(f"{passage} " + " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([10, 14, 80]))),) for _ in range(300)]
    df = spark.createDataFrame(rows * 2, "text string").repartition(5)
    found = [sorted(tuple(r) for r in nj.shared_signatures(df, 40_000, bucket=2000, hot=hot).collect()) for hot in (1e9, 2, 0)]
    assert len(found[0]) > 300 and max(r[3] for r in found[0]) > 100
    assert found[0] == found[1] == found[2]


def test_bytes_of_signatures_do_not_depend_on_buckets(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(" ".join(f"w{rng.randrange(9000)}" for _ in range(300)),) for _ in range(400)], "text string").repartition(1)
    n = sum(len(x) for (t,) in df.collect() for x, _ in nj.schemes(nj.shingles(t, nj.WordHashes()), 0))
    for bits in (3, 9):
        signed = df.mapInArrow(nj._sign(0, bits), nj._PARTS)
        held = sum(len(v) for r in signed.collect() for v in r if isinstance(v, (bytes, bytearray)))
        assert 4 * n < held < 6.2 * n


def test_repeated_sets_sign_once(spark):
    """Also where a set is in several blocks: a signature has each set once, and size is their number."""
    docs = [(t,) for _, t in varied(8, [30, 90, 140], groups=6)]
    once, often = (spark.createDataFrame(docs * k, "text string").repartition(k) for k in (1, 4))
    found = [nj.shared_signatures(df, 40_000).collect() for df in (once, often)]
    for rows in found:
        assert rows and len({(r["sig"], r["fp"]) for r in rows}) == len(rows)
        for sig in {r["sig"] for r in rows}:
            assert {r["size"] for r in rows if r["sig"] == sig} == {sum(r["sig"] == sig for r in rows)}
    assert {r["fp"] for r in found[0]} == {r["fp"] for r in found[1]}


def test_without_rounds_all_pairs_remain(spark):
    docs = varied(6, [12, 90], groups=6, copies=6)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, docs, rounds=0)} == brute(docs)


def test_subsets_of_second_level_parts():
    found = np.unique(np.random.default_rng(2).integers(0, 2**64, 100, dtype=np.uint64))
    whole = nj.subset_signatures(found, 6, 0)
    assert len(np.unique(whole)) == len(whole) > 2 * nj.most_different(100, 125)
    for i in range(100):  # one element is in one part, which two of the three subsets hold
        less = nj.subset_signatures(np.delete(found, i), 6, 0)
        assert len(np.setdiff1d(whole, less)) == 2 and len(np.setdiff1d(less, whole)) <= 2


def test_histogram_bound():
    found = np.unique(np.random.default_rng(3).integers(0, 2**64, 700, dtype=np.uint64))
    assert len(nj.histogram(found)) == 512 and nj.histogram(np.arange(300, dtype=np.uint64)) == b"\0"


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    at = {x: x for e in edges for x in e}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        at[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found) == set(at)
    for x in at:
        for y in (rng.choice(list(at)) for _ in range(20)):
            assert (found[x] == found[y]) == (root(x) == root(y))


def test_empty(spark):
    assert run(spark, []) == []
