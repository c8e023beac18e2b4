"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed to vectors, a document is the average of its vectors, and a
softmax over two classes follows (a word that repeats the one before it is one more feature); numpy stochastic gradient descent learns both. As averaging and the output
are linear, a trained model gives each word one number, so scoring is a sum over words.

The model is fitted on at most `sample` labelled rows (those with the least hash of their id), learning only
from rows outside the held-out fifth; every text is scored whole. Labels, language, source and id are no
inputs. Defined results: null, empty and blank texts get the model's score of a text without features; rows
without a label are scored like others; null labels are not learnt from; with no labels, or of one class
only, the score is that class's share, 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, worker_state

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
BUCKETS, DIMENSIONS, EPOCHS, RATE, SEED = 1 << 16, 8, 6, 0.3, 7
GRAMS = (1, 2, 3)
FOLDS, THRESHOLD = 5, 0.3
REMEMBERED = 400_000
#: A word that repeats the one before it is a feature of its own, in bucket 0, that counts so many times.
AGAIN = 5


def features(word: str) -> np.ndarray:
    """Buckets of a word: itself and its n-grams, with marked ends."""
    import xxhash

    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    parts = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return np.maximum(np.fromiter(map(xxhash.xxh32_intdigest, parts), np.int64, len(parts)) & (BUCKETS - 1), 1)


@dataclass
class Model:
    """What scoring needs: each bucket's share in the log odds, and the share of a text without features."""

    weights: np.ndarray
    empty: float


class Words(dict):
    """word -> place of its sum and its number of features."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.sums, self.sizes = weights, np.zeros(REMEMBERED), np.zeros(REMEMBERED)

    def __missing__(self, word: str) -> int:
        f = features(word)
        self.sums[len(self)], self.sizes[len(self)] = self.weights[f].sum(), len(f)
        self[word] = at = len(self)
        return at

    @staticmethod
    def repeats(at: np.ndarray) -> int:
        return int((at[1:] == at[:-1]).sum())

    def log_odds(self, words: list[str]) -> float:
        total = size = 0.0
        for i in range(0, len(words), 100_000):  # no more new words than there is room for
            part = words[i : i + 100_000]
            if len(self) + len(part) >= REMEMBERED:
                self.clear()
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            again = AGAIN * self.repeats(at)
            total, size = total + self.sums[at].sum() + again * self.weights[0], size + self.sizes[at].sum() + again
        return total / size if size else 0.0


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over documents in a fixed random order, with a falling rate."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(BUCKETS), share)
    known: dict[str, np.ndarray] = {}
    docs = []
    for text in texts:
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = features(w)
        again = AGAIN * sum(a == b for a, b in zip(words, words[1:]))
        ids, n = np.unique(np.concatenate([*(known[w] for w in words), np.zeros(again, np.int64)]), return_counts=True) if words else (np.empty(0, np.int64), np.empty(0))
        docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    random = np.random.Generator(np.random.PCG64(SEED))
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, steps, step = np.zeros((2, DIMENSIONS), np.float32), EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            (ids, p), rate = docs[i], RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            hidden = p @ vectors[ids]
            z = output @ hidden
            e = np.exp(z - z.max())
            wrong = -e / e.sum()
            wrong[int(labels[i])] += 1
            back = wrong @ output
            output += rate * np.outer(wrong, hidden)
            # by the root of a feature's share, so that rare but telling ones learn too
            vectors[ids] += (rate * np.sqrt(p))[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float64), share)


def fold(key: Column) -> Column:
    """The remainder that decides about holding out; null ids count as the text ''."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Model:
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(F.col(key)) != 0)).select(F.col(key).alias("labelled"), F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(sample)
    joined = docs.select(docs[key], docs[text].alias("t")).join(F.broadcast(chosen), docs[key] == F.col("labelled")).select("labelled", "y", "t")
    rows = sorted(((r.labelled, r.y, r.t or "") for r in joined.orderBy(F.xxhash64("labelled"), "labelled", "y", F.xxhash64("t")).limit(sample).collect()), key=lambda r: r)
    return fit([t for *_, t in rows], np.array([y for _, y, _ in rows], np.int64))


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted for every row. Nothing is shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    sent, empty = spark.sparkContext.broadcast(model.weights), model.empty
    name = f"classifier:{id(sent)}:{hash(model.weights.tobytes())}"
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        words = worker_state("classifier", name, lambda: Words(sent.value))
        for batch in batches:
            out = []
            for value in batch.column(1):
                split = (value.as_py() or "").split()
                out.append(float(1 / (1 + np.exp(-words.log_odds(split)))) if split and words.weights.any() else empty)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], names=[key, "held_out", "score"])

    scored = docs.select(docs[key], docs[text].cast("string"), (fold(docs[key]) == 0).alias("h")).mapInArrow(work, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
