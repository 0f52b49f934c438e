"""Language-model scores from a subword lattice.

The vocabulary is a public tokenizer's, with its scores: which pieces there are is
never trained. Their probabilities are: first from the file's scores, then
re-estimated from the training documents in a few steps of expectation maximisation, each of
which counts the expected uses of each piece over all segmentations of all training
words. A text's probability is the sum over all its segmentations into pieces, computed
by the forward recursion in log space. No piece spans white space, so that sum
is the product of the sums of its words, and each different word of the corpus
runs through the recursion once a step. Words of equal length run through it
together, in numpy: a step of the recursion is one operation on all of them.

Words, not texts, meet the counts: a table of the most frequent words goes to the
executors (a fixed number of rows), the remaining (word, document) pairs join
the word table by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fold, materialize, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space in ASCII's sense, A-Z lowered."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


class Vocabulary:
    """pieces: text -> id; by_byte: ids of the byte pieces; first: log probabilities from the file's scores.

    The file scores merges by their rank, 0 for the first and one less for each
    next one; a piece of rank r starts with a weight of 1 / (r + offset), the
    rank-frequency law, single bytes with that of the last rank.
    """

    def __init__(self, path: str = VOCABULARY, offset: float = 50.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        self.pieces = {model.id_to_piece(i): k for k, i in enumerate(ids) if not model.is_byte(i)}
        self.by_byte = {int(model.id_to_piece(i)[3:5], 16): k for k, i in enumerate(ids) if model.is_byte(i)}
        ranks = np.array([np.nan if model.is_byte(i) else -model.get_score(i) for i in ids])
        ranks[np.isnan(ranks)] = np.nanmax(ranks) if len(ranks) else 0
        weight = 1 / (ranks + offset)
        self.first = np.log(weight / weight.sum())
        beginnings = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)}, key=len)
        node = {"": 0} | {p: i for i, p in enumerate(beginnings, 1)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in beginnings], np.int64)
        order = np.argsort(keys)
        #: The tree of all beginnings of pieces, as sorted (node, character) keys and the nodes they lead to.
        self.keys, self.nodes = keys[order], order.astype(np.int64) + 1
        #: Each node's piece, -1 for what is no piece itself.
        self.piece_at = np.array([-1] + [self.pieces.get(p, -1) for p in beginnings], np.int64)
        self.bytes = np.array([self.by_byte[b] for b in range(256)])

    def __getstate__(self):
        """What the recursion needs: arrays only."""
        return {c: getattr(self, c) for c in ("first", "keys", "nodes", "piece_at", "bytes")}

    def __setstate__(self, state):
        self.__dict__.update(state)


def _by_length(words: list[str], most: int):
    """Places of words of equal length, in lists of `most` characters at most, or of one word."""
    places: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        places.setdefault(len(word), []).append(at)
    for n, own in places.items():
        step = max(1, most // (n + 1))
        for i in range(0, len(own), step):
            yield own[i : i + step]


class Lattice:
    """Forward and backward recursions over words' segmentations, with given log probabilities."""

    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray):
        self.v, self.logp = vocabulary, np.append(logp, 0.0)

    def _edges(self, chars: np.ndarray):
        """(start, end, rows, ids, log probabilities) of pieces in words of equal length, by start; ids -1 are characters in bytes.

        A character that is no piece is spelled in bytes.
        """
        v, (rows, n) = self.v, chars.shape
        for i in range(n):
            row, node = np.arange(rows), np.zeros(rows, np.int64)
            for j in range(i, n):
                key = node << 21 | chars[row, j]
                at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
                there = v.keys[at] == key
                ids = np.where(there, v.piece_at[v.nodes[at]], -1)
                use = ids >= 0
                if j == i:
                    lp = self.logp[ids]
                    if not use.all():
                        spelled, back = np.unique(chars[~use, i], return_inverse=True)
                        lp[~use] = np.array([self.logp[self._spelled(c)].sum() for c in spelled])[back]
                    yield i, j + 1, row, ids, lp
                elif use.any():
                    yield i, j + 1, row[use], ids[use], self.logp[ids[use]]
                row, node = row[there], v.nodes[at[there]]
                if not len(row):
                    break

    def _spelled(self, char: int) -> np.ndarray:
        return self.v.bytes[np.frombuffer(chr(char).encode("utf-8", "surrogatepass"), np.uint8)]

    @staticmethod
    def _chars(words: list[str]) -> np.ndarray:
        text = "".join(["▁" + w for w in words])
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), -1)

    def _forward(self, chars: np.ndarray, edges) -> np.ndarray:
        f = np.full((chars.shape[0], chars.shape[1] + 1), -np.inf)
        f[:, 0] = 0
        for i, j, row, _, lp in edges:
            f[row, j] = np.logaddexp(f[row, j], f[row, i] + lp)
        return f

    def logprobs(self, words: list[str], most: int = 1 << 18) -> np.ndarray:
        """The log probability of each word, summed over its segmentations."""
        out = np.empty(len(words))
        for own in _by_length(words, most):
            chars = self._chars([words[k] for k in own])
            out[own] = self._forward(chars, self._edges(chars))[:, -1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, out: np.ndarray, most: int = 1 << 17) -> None:
        """Add to out the expected uses of each piece in `weights` occurrences of the words."""
        for own in _by_length(words, most):
            chars = self._chars([words[k] for k in own])
            edges = list(self._edges(chars))
            f = self._forward(chars, edges)
            # posterior flow runs backward along the edges: what reaches j splits over the pieces that end there
            flow = np.zeros_like(f)
            flow[:, -1] = weights[own]
            for i, j, row, ids, lp in sorted(edges, key=lambda e: -e[1]):
                share = flow[row, j] * np.exp(f[row, i] + lp - f[row, j])
                flow[row, i] += share
                use = ids >= 0
                out += np.bincount(ids[use], share[use], len(out))
                for char in np.unique(chars[row[~use], i]) if not use.all() else ():
                    np.add.at(out, self._spelled(char), share[~use][chars[row[~use], i] == char].sum())


def word_blocks(batches, *columns: str, most: int = 100_000):
    """Rows of several batches together, so that many words have equal lengths: words as text, and the columns."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield _words_and(held, columns)
            held, n = [], 0
    if n:
        yield _words_and(held, columns)


def _words_and(held, columns):
    table = pa.Table.from_batches(held).combine_chunks()
    return [w.decode("utf-8", "surrogatepass") for w in table.column("word").to_pylist()], table.column("word").combine_chunks(), *[table.column(c).combine_chunks() for c in columns]


def count_words(docs: DataFrame, *, text_col="text", train_col="_train", limit=400_000) -> DataFrame:
    """word binary, c long (in training rows), seen long (in all rows), over all whole texts."""

    def run(batches):
        train, rest = Counter(), Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            c = [train[w] for w in words]
            seen = [k + rest[w] for k, w in zip(c, words, strict=True)]
            train.clear(), rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(seen, pa.int64())], names=["word", "c", "seen"])

        for batch in batches:
            for text, learn in zip(batch.column(text_col), batch.column(train_col), strict=True):
                (train if learn.as_py() else rest).update(words_of(text.as_py()))
                if len(train) + len(rest) > limit:
                    yield flush()
        yield flush()

    counted = docs.select(text_col, train_col).mapInArrow(run, "word binary, c long, seen long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit_pieces(words: DataFrame, vocabulary: Vocabulary, n_docs: int, *, steps=3, prior=3_000.0) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end of a text, from all training words, after some steps of expectation maximisation.

    prior is the number of pieces that the file's scores count for in each step.
    """
    n = len(vocabulary.first)
    logp, end, total = vocabulary.first, n_docs + 1.0, prior * np.exp(vocabulary.first)
    for _ in range(steps):

        def run(batches, logp=logp):
            lattice = Lattice(vocabulary, logp)
            out = np.zeros(n)
            for block, _, c in word_blocks(batches, "c"):
                lattice.expected(block, c.to_numpy().astype(float), out)
            used = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used], pa.float64())], names=["piece", "uses"])

        uses = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, uses double")
        total = prior * np.exp(vocabulary.first)
        for piece, x in uses.groupBy("piece").agg(F.sum("uses")).collect():  # a row per piece of the vocabulary at most
            total[piece] += x
        logp = np.log(total / (total.sum() + end))
    return logp, math.log(end / (total.sum() + end))


def score_documents(docs: DataFrame, *, train=None, vocabulary_path=VOCABULARY, id_col="doc_id", text_col="text", frequent=200_000) -> DataFrame:
    """A row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train is a boolean column, true for the rows to learn from. Tokens are words and
    one end per text. base_score is the word-unigram score with half a count
    added; score is the lattice's log10 probability. Null texts count as empty,
    with the end as their only token; repeated rows have equal results; without
    any training row base_score is 0 per token and score rests on the file's
    scores; an empty table gives an empty result. Other columns are ignored.
    frequent bounds the rows of the word table that goes to the executors. Words of any
    length run whole; words that tie in frequency go by their bytes.
    """
    vocabulary = Vocabulary(vocabulary_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), (F.lit(True) if train is None else F.coalesce(train, F.lit(True))).alias("_train"))
    words = materialize(count_words(rows), "lm-words")
    n_docs = rows.filter("_train").count()
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = tokens + n_docs, kinds + (n_docs > 0)
    logp, log_end = fit_pieces(words, vocabulary, n_docs)
    below = tokens + 0.5 * (kinds + 1)

    def score_words(batches):
        lattice = Lattice(vocabulary, logp)
        for block, word, c, seen in word_blocks(batches, "c", "seen"):
            c = c.to_numpy()
            base = np.log10((c + 0.5) / below)
            found = lattice.logprobs(block) / LN10
            yield pa.RecordBatch.from_arrays([word, pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(found), seen], names=["word", "known", "base", "lattice", "seen"])

    scored = materialize(words.mapInArrow(score_words, "word binary, known long, base double, lattice double, seen long"), "lm-scores")
    top = scored.orderBy(F.desc("seen"), "word").limit(frequent).drop("seen").toArrow()
    common = {w: v for w, *v in zip(*[top.column(c).to_pylist() for c in ("word", "known", "base", "lattice")], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(common)
    end_base = math.log10((n_docs + 0.5) / below)

    def run(batches):
        near = shared.value
        for batch in batches:
            n, known, base, lattice, rare, times = [], [], [], [], [], []
            for text in batch.column("text"):
                own = Counter(words_of(text.as_py()))
                k, b, s, far = int(n_docs > 0), end_base, log_end / LN10, []
                for w, t in own.items():
                    v = near.get(w)
                    if v is None:
                        far.append(w)
                    else:
                        k += t * v[0]
                        b += t * v[1]
                        s += t * v[2]
                n.append(sum(own.values()) + 1), known.append(k), base.append(b), lattice.append(s)
                rare.append(far), times.append([own[w] for w in far])
            cols = [batch.column(c) for c in ("_id", "_train", "_key")]
            cols += [pa.array(v, t) for v, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (lattice, pa.float64()), (rare, pa.list_(pa.binary())), (times, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    # rows that share id and text are one key, counted by _rows
    keyed = rows.withColumn("_key", F.xxhash64("text"))
    schema = T.StructType([*[keyed.schema[c] for c in ("_id", "_train", "_key")], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("lattice", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType())))]])
    parts = keyed.mapInArrow(run, schema)
    kept = ["_id", "_train", "_key"]
    near = parts.select(*kept, F.lit(1).cast("long").alias("_rows"), "n", "known", "base", "lattice")
    pairs = parts.select(*kept, F.explode(F.arrays_zip("rare", "times")).alias("p")).select(*kept, F.col("p.rare").alias("word"), F.col("p.times").alias("t"))
    far = pairs.join(scored.hint("shuffle_merge"), "word").select(
        *kept, F.lit(0).cast("long").alias("_rows"), F.lit(0).cast("long").alias("n"), (F.col("t") * F.col("known")).alias("known"), (F.col("t") * F.col("base")).alias("base"), (F.col("t") * F.col("lattice")).alias("lattice")
    )
    total = near.unionByName(far).groupBy(*kept).agg(*[F.sum(c).alias(c) for c in ("_rows", "n", "known", "base", "lattice")])
    each = lambda c: F.col(c) / F.col("_rows")
    return total.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).select(
        F.col("_id").alias(id_col),
        (~F.col("_train")).alias("held_out"),
        each("n").cast("long").alias("n_tokens"),
        each("known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        each("base").alias("base_score"),
        each("lattice").alias("score"),
    )


def op4_subword_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train=fold() % 5 != 1)
