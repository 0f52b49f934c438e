"""Toxicity with a counterfactually regularised classifier.

Logistic regression on the words a text holds and on how words begin, trained in numpy on a bounded
sample of labelled rows. Each sampled text that names a group also comes with
its counterfactual, in which every identity term is swapped for another of its
family; the squared change of the logit between the two is penalised. A word
that merely names a group so gets no weight of its own, which keeps neutral
mentions clean, while words that carry toxicity wherever they stand keep theirs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import bounded_sample
from ._shared import broadcast_if_small, fold, table
from .decontam import fold_words

#: Families of identity terms; a term is swapped for the next of its family.
IDENTITY_FAMILIES = [
    ["women", "men"], ["woman", "man"], ["female", "male"], ["girls", "boys"], ["girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"], ["queer", "heterosexual"],
    ["black", "white", "asian", "latino"], ["african", "european"], ["immigrant", "native"], ["immigrants", "natives"],
    ["old", "young"], ["elderly", "youthful"], ["deaf", "hearing"], ["blind", "sighted"], ["disabled", "abled"],
    ["mexican", "american", "chinese", "indian", "german", "french"],
    ["frauen", "männer"], ["frau", "mann"], ["mädchen", "jungen"], ["muslime", "christen", "juden", "hindus"], ["schwule", "lesben", "heteros"],
    ["schwarze", "weiße"], ["ausländer", "einheimische"], ["türken", "deutsche", "polen"], ["behinderte", "gesunde"],
    ["femmes", "hommes"], ["femme", "homme"], ["filles", "garçons"], ["musulmans", "chrétiens", "juifs", "hindous"], ["homosexuels", "hétérosexuels"],
    ["noirs", "blancs"], ["étrangers", "français"], ["arabes", "européens"], ["handicapés", "valides"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["niñas", "niños"], ["musulmanes", "cristianos", "judíos", "hindúes"], ["homosexuales", "heterosexuales"],
    ["negros", "blancos"], ["extranjeros", "nativos"], ["gitanos", "españoles"], ["discapacitados", "sanos"],
]
#: A term in two families swaps within the first.
SWAP = {a.encode(): f[(i + 1) % len(f)].encode() for f in reversed(IDENTITY_FAMILIES) for i, a in enumerate(f)}
BITS = 20


#: Lengths, in characters, of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: A beginning counts by how many different words of the text share it, up to so many.
SHARED = 3


def _bucket(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little") >> (32 - BITS)


class Buckets(dict):
    """A word's bucket, and for each of its beginnings the buckets of 1, 2, ... words that share it."""

    def __missing__(self, word: bytes):
        if len(self) >= 300_000:
            self.clear()
        letters = word.decode("utf-8", "surrogatepass")
        starts = [letters[:n] for n in PREFIXES if len(letters) > n]
        found = [tuple(_bucket(f"{s} {k}".encode("utf-8", "surrogatepass")) for k in range(SHARED)) for s in starts]
        value = self[word] = (_bucket(word), found)
        return value

    def of(self, words: set[bytes]) -> list[int]:
        own, shared = set(), {}
        for word in words:
            whole, starts = self[word]
            own.add(whole)
            for ids in starts:
                k = shared[ids] = shared.get(ids, -1) + 1
                if k < SHARED:
                    own.add(ids[k])
        return sorted(own)


def text_features(text: str | None, buckets: Buckets) -> tuple[list[int], list[int] | None]:
    """Sorted buckets of a text's words and their beginnings, and of its counterfactual's where it names a group."""
    words = set(fold_words(text))
    own = buckets.of(words)
    if words.isdisjoint(SWAP):
        return own, None
    return own, buckets.of({SWAP.get(w, w) for w in words})


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, buckets: Buckets | None = None) -> float:
        words = set(fold_words(text))
        ids = (LiveBuckets(self.weights) if buckets is None else buckets).of(words)
        z = self.bias + float(self.weights[ids].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class LiveBuckets(Buckets):
    """Of a word's buckets those that can add to a score: beginnings without any weight fall out when the word is first seen."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.live = set(np.flatnonzero(weights).tolist())

    def __missing__(self, word: bytes):
        whole, starts = super().__missing__(word)
        starts = [ids for ids in starts if not self.live.isdisjoint(ids)]
        value = self[word] = (whole, starts) if starts or whole in self.live else None
        return value

    def of(self, words: set[bytes]) -> list[int]:
        own, shared = set(), {}
        for found in map(self.__getitem__, words):
            if found is None:
                continue
            own.add(found[0])
            for ids in found[1]:
                k = shared[ids] = shared.get(ids, -1) + 1
                if k < SHARED:
                    own.add(ids[k])
        return sorted(own)


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows) if rows else np.empty(0, np.int32), np.cumsum([0, *map(len, rows)])


def train(samples: list[tuple[np.ndarray, np.ndarray | None, int, float]], *, min_df=3, epochs=12, rate=0.1, l2=2e-4, l1=1e-3, swap_penalty=1.0, seed=8) -> ToxicityModel:
    """Fit on (features, counterfactual features, label, importance weight) rows by Adagrad on mini-batches.

    Features of fewer than min_df sampled rows get no weight. Without rows of
    both labels the model scores all texts alike, by the share of label 1.
    """
    width = 1 << BITS
    weight_of = np.array([s[3] for s in samples])
    y = np.array([s[2] for s in samples], float)
    share = float((y * weight_of).sum() / weight_of.sum()) if len(samples) else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    w = np.zeros(width)
    if len(samples) == 0 or y.min() == y.max():
        return ToxicityModel(w, prior)
    flat, _ = _csr([s[0] for s in samples])
    known = np.bincount(flat, minlength=width) >= min_df
    clean = [(s[0][known[s[0]]], None if s[1] is None else s[1][known[s[1]]]) for s in samples]
    rng = np.random.default_rng(seed)
    b, seen, seen_b = prior, np.full(width, 1e-8), 1e-8
    weight_of = weight_of / weight_of.mean()
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            ids, ends = _csr([clean[i][0] for i in pick])
            row = np.repeat(np.arange(len(pick)), np.diff(ends))
            z = np.bincount(row, w[ids], len(pick)) + b
            g = weight_of[pick] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            grad = np.bincount(ids, g[row], width)
            swapped = [i for i in pick if clean[i][1] is not None]
            for i in swapped:
                a, c = clean[i]
                change = 2 * swap_penalty * (w[a].sum() - w[c].sum()) / len(pick)
                np.add.at(grad, a, change)
                np.subtract.at(grad, c, change)
            hit = np.flatnonzero(grad)
            grad = grad[hit] + l2 * w[hit]
            seen[hit] += grad**2
            step = rate / np.sqrt(seen[hit])
            moved = w[hit] - step * grad
            w[hit] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            seen_b += g.sum() ** 2
            b -= rate * 0.5 * g.sum() / np.sqrt(seen_b)
    return ToxicityModel(w.astype(np.float32), float(b))


def fit_toxicity_model(docs: DataFrame, labels: DataFrame | None = None, *, per_label=6000, id_col="doc_id", text_col="text", label_col="toxic", **options) -> ToxicityModel:
    """Train on about per_label rows of each label at most.

    labels holds ids with labels 0 and 1 (None: docs holds them itself); other labels and ids without
    a text are left out, an id with several labels counts with each. The sample is
    drawn from the narrow labels; texts are fetched by its ids only, which go to the
    executors behind a count. Rows are weighted by the inverse of their label's
    sampling rate, so scores keep the share of label 1 that all rows have.
    """
    own = docs if labels is None else labels
    usable = own.filter(F.col(label_col).isin(0, 1)).withColumn("_y", F.col(label_col).cast("int"))
    sample, rates = bounded_sample(usable, "_y", per_label, key=F.col(id_col), seed=8)
    if labels is not None:
        sample = docs.select(id_col, text_col).join(broadcast_if_small(sample.select(id_col, "_y")), id_col)
    sample = sample.select(id_col, text_col, "_y")

    def extract(batches):
        buckets = Buckets()
        for batch in batches:
            found = [text_features(t.as_py(), buckets) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array([None if f[i] is None else np.asarray(f[i], np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)], batch.column("_y")],
                names=[id_col, "_own", "_swapped", "_y"],
            )

    schema = T.StructType([sample.schema[id_col], T.StructField("_own", T.BinaryType()), T.StructField("_swapped", T.BinaryType()), T.StructField("_y", T.IntegerType())])
    rows = sorted(sample.mapInArrow(extract, schema).collect(), key=lambda r: (str(r[0]), r[3], bytes(r[1])))
    ids = lambda raw: None if raw is None else np.frombuffer(raw, np.int32)
    return train([(ids(r[1]), ids(r[2]), r[3], 1 / rates[r[3]]) for r in rows], **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col="text", cut=0.3) -> DataFrame:
    """docs with score double (0 to 1) and predicted int (1 from cut on).

    Null and empty texts get the model's score for no words at all. Columns of
    docs with the added names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches):
        buckets = LiveBuckets(model.weights)
        for batch in batches:
            scores = [model.score(t.as_py(), buckets) for t in batch.column(text_col)]
            cols = [batch.column(c) for c in names] + [pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in names], *added]))


def held_out(doc_id="doc_id"):
    return fold(doc_id) % 4 == 2


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity_model(docs, labels.filter(~F.coalesce(held_out(), F.lit(True))))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
