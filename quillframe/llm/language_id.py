"""Language identification with averaged hashed subword embeddings.

A text's features are the byte n-grams of its words, hashed to buckets. Each
bucket has an embedding; their average goes through a linear layer to a softmax.
Embeddings and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. Part of the sample is held back to
fit the softmax's temperature and the confidence below which a text is rejected.

Scoring needs the product of embeddings and layer only, a small table that goes
to the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._fit import bounded_sample
from ._shared import fold, table

SIZES = (2, 3, 4)
BITS = 15
DIM = 16
#: Everything in ASCII that is no letter parts words; A-Z are lowered.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams that the words of a whole text hold, with a space at either end of each."""
    raw = b" ".join([b"", *text.encode("utf-8", "surrogatepass").translate(_FOLD).split(), b""])
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(x) < n:
            continue
        code = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | x[i : len(x) - n + 1 + i]
        code *= np.uint64(0x9E3779B97F4A7C15)
        out.append((code >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class LanguageModel:
    """languages; table[bucket, language] of summed logits; temperature; least confidence that is accepted."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        ids = features(text)
        logits = self.bias + (self.table[ids].mean(axis=0) if len(ids) else 0)
        logits = logits / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, at most 2**BITS, and how often each occurs."""
    ids, counts = np.unique(features(text), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int64)


def train(samples: Iterable[tuple[np.ndarray, np.ndarray, str]], *, epochs=4, rate=1.0, reject=0.001, seed=5) -> LanguageModel:
    """Fit on (buckets, counts, language) rows; reject is the share of right calibration answers that may be rejected.

    Repeated rows count as often as they occur. Without rows the model knows no
    language; with one language it gives that to all.
    """
    # one buffer each for all rows: many small arrays would stay with the driver's allocator
    all_ids, all_counts, sizes, names = bytearray(), bytearray(), [], []
    for ids, counts, lang in samples:
        all_ids += np.asarray(ids, np.uint16).tobytes()
        all_counts += np.asarray(counts, np.uint32).tobytes()
        sizes.append(len(ids)), names.append(lang)
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    ends = np.cumsum([0, *sizes])
    all_ids, all_counts = np.frombuffer(all_ids, np.uint16), np.frombuffer(all_counts, np.uint32)
    truth_of = [languages.index(lang) for lang in names]

    class Rows:
        def __len__(self):
            return len(names)

        def __getitem__(self, i):
            own = slice(ends[i], ends[i + 1])
            counts = all_counts[own]
            return all_ids[own].astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32), truth_of[i]

    rows = Rows()
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    learn = order[len(rows) // 5 :]
    k = len(languages)
    emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    # lengths differ by orders of magnitude: the step on an embedding is scaled to its share of the text
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, share, y = rows[i]
            if not len(ids):
                continue
            mean = share @ emb[ids]
            error = _softmax(mean @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= step * 0.1 * np.outer(mean, error)
            bias -= step * 0.01 * error
            emb[ids] -= (step * len(ids) ** 0.5) * share[:, None] * back[None, :]
    table = (emb @ out).astype(np.float32)
    logits = np.array([(rows[i][1] @ table[rows[i][0]] if len(rows[i][0]) else np.zeros(k)) + bias for i in (held if len(held) else order)], np.float64)
    truth = np.array([rows[i][2] for i in (held if len(held) else order)])
    temperatures = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    # never above one half: a text that one language explains better than all others together is kept
    threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return LanguageModel(languages, table, bias.astype(np.float32), temperature, threshold)


def fit_language_model(docs: DataFrame, *, per_language=1000, id_col="doc_id", text_col="text", lang_col="lang", **options) -> LanguageModel:
    """Train on about per_language rows of each language at most, of the rows given that have text and language.

    What comes to the driver are counted features, compressed, 6 * 2**BITS bytes a row at most however long its text.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample, _ = bounded_sample(usable, lang_col, per_language, key=F.col(id_col), seed=6)

    def extract(batches):
        for batch in batches:
            texts, langs = batch.column("_t").to_pylist(), batch.column("_l").to_pylist()
            found = [(*counted_features(t), lang) for t, lang in zip(texts, langs, strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.diff(f[0], prepend=0).astype(np.uint16).tobytes(), 1) for f in found], pa.binary()), pa.array([zlib.compress(f[1].astype(np.uint32).tobytes(), 1) for f in found], pa.binary()), pa.array([f[2] for f in found], pa.string())], names=["ids", "counts", "lang"])

    rows = sample.select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")).mapInArrow(extract, "ids binary, counts binary, lang string").collect()
    rows.sort(key=lambda r: (r[2], bytes(r[0]), bytes(r[1])))  # the order of collected rows is free; that of training isn't
    unpacked = lambda x, kind: np.frombuffer(zlib.decompress(x), kind)
    return train(((np.cumsum(unpacked(i, np.uint16), dtype=np.int32), unpacked(c, np.uint32), lang) for i, c, lang in rows), **options)


ADDED = ("lang_pred", "score", "rejected")


def predict_language(docs: DataFrame, model: LanguageModel, *, text_col="text", added=ADDED) -> DataFrame:
    """docs with lang_pred string, score double and rejected boolean, under the names in added.

    Null texts and texts without any letter (in Unicode's sense) get `und`, score 0
    and are rejected, as is all where the model has learned no language. Columns
    of docs with the added names are replaced; an empty table gives an empty result.
    """
    docs = docs.drop(*added)
    names = docs.columns
    fields = [T.StructField(c, kind) for c, kind in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]

    def run(batches):
        for batch in batches:
            pred, score, rejected = [], [], []
            for text in batch.column(text_col):
                text = text.as_py()
                if not has_letter(text) or not model.languages:
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                p = model.probabilities(text)
                best = int(p.argmax())
                pred.append(model.languages[best]), score.append(float(p[best])), rejected.append(bool(p[best] < model.threshold))
            cols = [batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in names], *fields]))


def held_out(doc_id="doc_id"):
    return fold(doc_id) % 3 == 1


def fitted_on(docs: DataFrame) -> LanguageModel:
    return fit_language_model(docs.filter(~F.coalesce(held_out(), F.lit(True))))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted_on(docs)
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
