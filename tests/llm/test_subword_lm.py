import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import subword_lm as lm

pytestmark = pytest.mark.skipif(not os.path.exists(lm.VOCABULARY), reason="no vocabulary file")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


DOCS = [(i, " ".join(f"word{(i * k) % 13} the" for k in range(i % 9))) for i in range(60)] + [(70, None), (71, ""), (72, "Ünïcode 梦 \x01 ▁x"), (73, "z" * 3000), (90, "again"), (90, "again")]


def test_lattice_sums_all_segmentations():
    v = lm.Vocabulary()
    lattice = lm.Lattice(v, v.first)

    def every(s):
        if not s:
            return 1.0
        total = 0.0
        for j in range(1, len(s) + 1):
            k = v.pieces.get(s[:j])
            if k is not None:
                total += math.exp(v.first[k]) * every(s[j:])
            elif j == 1:
                total += math.exp(sum(v.first[v.by_byte[b]] for b in s[:1].encode())) * every(s[1:])
        return total

    for word in ("hello", "thé", "a", "梦x", "\x01"):
        assert abs(lattice.logprobs([word])[0] - math.log(every("▁" + word))) < 1e-9
        uses = np.zeros(len(v.first))
        lattice.expected([word], np.array([2.0]), uses)
        assert uses.sum() >= 2.0
    words = ["hello", "thé", "a", "梦x", "\x01", "there", "hello", "zzzzz", "", "x" * 5000]
    together = lattice.logprobs(words)
    assert np.allclose(together, [lattice.logprobs([w])[0] for w in words], rtol=0, atol=1e-9)
    both, alone = np.zeros(len(v.first)), np.zeros(len(v.first))
    lattice.expected(words, np.arange(10.0), both)
    for k, w in enumerate(words):
        lattice.expected([w], np.array([float(k)]), alone)
    assert np.allclose(both, alone)


def test_expected_uses_are_those_of_all_segmentations():
    v = lm.Vocabulary()
    lattice = lm.Lattice(v, v.first)

    def every(s):
        if not s:
            yield 1.0, ()
        for j in range(1, len(s) + 1):
            k = v.pieces.get(s[:j])
            ids = (k,) if k is not None else tuple(v.by_byte[b] for b in s[:1].encode()) if j == 1 else None
            for p, rest in every(s[j:]) if ids is not None else ():
                yield p * math.exp(sum(v.first[i] for i in ids)), ids + rest

    for word in ("hello", "thé", "梦x"):
        ways = list(every("▁" + word))
        want = np.zeros(len(v.first))
        for p, ids in ways:
            for i in ids:
                want[i] += 3 * p / sum(q for q, _ in ways)
        got = np.zeros(len(v.first))
        lattice.expected([word], np.array([3.0]), got)
        assert np.allclose(got, want)


def test_vocabulary_probabilities():
    v = lm.Vocabulary()
    assert abs(np.exp(v.first).sum() - 1) < 1e-9


@pytest.mark.parametrize("frequent", [200_000, 0, 3])
def test_scores(spark, frequent):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in DOCS], "doc_id long, text string, score double").repartition(3)
    out = lm.score_documents(df, train=F.col("doc_id") % 5 != 1, frequent=frequent).collect()
    assert len(out) == len(DOCS)
    c = Counter(x for i, t in DOCS if i % 5 != 1 for x in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = {}
    for i, t in DOCS:
        ts = tokens(t)
        want[i] = (len(ts), sum(c[x] > 0 for x in ts), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in ts))
    for r in out:
        n, known, all_, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, all_) and abs(r["base_score"] - base) < 1e-6
        assert r["held_out"] == (r["doc_id"] % 5 == 1) and r["score"] < 0
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[70] == by[71] and by[73] < by[71]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_documents(df, train=F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert lm.score_documents(df.limit(0)).count() == 0
