"""Quality by random-indexing word vectors and a two-layer network.

A token is a run of letters and digits (lower-cased) or a run of other marks.
Tokens that say how a text is written are added: words in capitals, a word
that repeats the one before, three words in a row that the text has had
before. Every token has a sparse random index vector (by its hash); its word
vector is the sum of the index vectors around its occurrences in the fitting
sample and its own, damped and scaled to length one. A document is pooled to
the mean and the spread of its tokens' vectors, and a numpy network of two
layers gives its log-odds. Part of the sample is held back to choose the
temperature by which log-odds are divided, so that scores are calibrated.

Defined results: a text without tokens (null, empty) is pooled to zeros and
scored like any other. Tokens that the sample does not hold count by one
shared vector for their kind. Without labels of both classes every score is
that class's share (0.5 without labels). Repeated rows stay; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, table, texts_of
from .labelled import FIT_DOCS, fitted, fold

DIMS, HIDDEN = 96, 24
#: Entries of an index vector that are not 0, and neighbours on each side.
SPARSE, REACH = 6, 2
#: Sample documents that hold a token at least, for it to have a vector of its own.
LEAST_DOCS = 3
STEPS, BATCH, RATE, DECAY = 1500, 128, 0.003, 1e-4
#: Rows of the table that are weighted at a time.
BLOCK = 4096
#: Part of the sample that only sets the temperature.
CALIBRATE = 0.2
THRESHOLD = 0.3
SEED = 5

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
CAPITALS, AGAIN, HEARD, NEW_WORD, NEW_MARK = "\x01caps", "\x01again", "\x01heard", "\x01word", "\x01mark"


def tokens_of(text: str) -> list[str]:
    out, before, earlier = [], ("", ""), set()
    for token in TOKENS.findall(text):
        low = token.lower()
        out.append(low)
        if not low[0].isalnum():
            continue
        if len(token) > 1 and token.isupper():
            out.append(CAPITALS)
        if low == before[1]:
            out.append(AGAIN)
        three = (*before, low)
        if three in earlier:
            out.append(HEARD)
        earlier.add(three)
        before = (before[1], low)
    return out


def index_entries(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a token's index vector; it is 0 elsewhere."""
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    signs = rng.choice([-1.0, 1.0], SPARSE)
    return rng.choice(DIMS, SPARSE, replace=False), signs


def index_vector(token: str) -> np.ndarray:
    v = np.zeros(DIMS)
    at, signs = index_entries(token)
    v[at] = signs
    return v


class Vectors:
    """Word vectors of the sample's tokens; the first rows stand for tokens it lacks."""

    def __init__(self, texts: list[str]) -> None:
        first: dict[str, int] = {}
        bags = [np.array([first.setdefault(w, len(first)) for w in tokens_of(t)], np.int32) for t in texts]
        held = np.zeros(len(first), np.int64)
        for bag in bags:
            held[np.unique(bag)] += 1
        tokens = list(first)
        kept = sorted(np.flatnonzero(held >= LEAST_DOCS).tolist(), key=tokens.__getitem__)
        names = [NEW_WORD, NEW_MARK, *(tokens[i] for i in kept)]
        self.number = {w: i for i, w in enumerate(names)}
        final = np.array([int(not w[0].isalnum()) for w in tokens], np.int32)
        final[kept] = np.arange(2, len(names))
        self.bags = [final[b] for b in bags]  # of the sample, for fitting only
        del first, tokens, held, bags
        n = len(names)
        at, signs = np.empty((n, SPARSE), np.int64), np.empty((n, SPARSE), np.float32)
        for i, w in enumerate(names):
            at[i], signs[i] = index_entries(w)
        total = np.zeros((n, DIMS), np.float32)
        np.put_along_axis(total, at, signs, 1)
        sums = total.reshape(-1)
        for ids in self.bags:
            wide = ids.astype(np.int64)
            for k in range(1, REACH + 1):
                if len(ids) > k:
                    pairs, times = np.unique(wide[:-k] * n + wide[k:], return_counts=True)
                    a, b, t = pairs // n, pairs % n, times[:, None].astype(np.float32)
                    np.add.at(sums, (a[:, None] * DIMS + at[b]).ravel(), (signs[b] * t).ravel())
                    np.add.at(sums, (b[:, None] * DIMS + at[a]).ravel(), (signs[a] * t).ravel())
        for i in range(0, n, BLOCK):
            part = total[i : i + BLOCK]
            index = np.zeros_like(part)
            np.put_along_axis(index, at[i : i + BLOCK], signs[i : i + BLOCK], 1)
            part = np.sign(part) * np.log1p(np.abs(part)) + index
            total[i : i + BLOCK] = part / np.linalg.norm(part, axis=1, keepdims=True)
        self.table = total

    def ids(self, bag: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([i if (i := get(w)) is not None else int(not w[0].isalnum()) for w in bag], np.int64)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(2 * DIMS)
        there, times = np.unique(ids, return_counts=True)
        rows, share = self.table[there], (times / len(ids)).astype(np.float32)
        mean = share @ rows
        return np.concatenate([mean, np.sqrt(np.maximum(share @ rows**2 - mean**2, 0))]).astype(np.float64)


class Model:
    def __init__(self, vectors: Vectors, centre: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float) -> None:
        self.vectors, self.centre, self.scale, self.layers, self.temperature = vectors, centre, scale, layers, temperature

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.log_odds(np.stack([self.vectors.pooled(self.vectors.ids(tokens_of(t))) for t in texts])) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Constant:
    def __init__(self, share: float) -> None:
        self.share = share

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.share)


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of least log-loss."""
    grid = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
    loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], y: list[int], seed: int = SEED) -> Model | Constant:
    if len(set(y)) < 2:
        return Constant(float(y[0]) if y else 0.5)
    rng = np.random.default_rng(seed)
    vectors = Vectors(texts)
    x, label = np.stack([vectors.pooled(b) for b in vectors.bags]), np.array(y, float)
    vectors.bags = []
    centre, scale = x.mean(0), x.std(0) + 1e-3
    order = rng.permutation(len(x))
    kept, learn = np.split(order, [int(CALIBRATE * len(x))])
    if len(set(label[learn])) < 2:
        kept, learn = order[:0], order
    layers = [rng.normal(0, (2 * DIMS) ** -0.5, (2 * DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    xs, ys = (x[learn] - centre) / scale, label[learn]
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(xs), BATCH)
        a, t = xs[pick], ys[pick]
        w1, b1, w2, b2 = layers
        h = np.tanh(a @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50))) - t) / BATCH
        back = d[:, None] * w2 * (1 - h**2)
        grads = [a.T @ back + DECAY * w1, back.sum(0), h.T @ d + DECAY * w2, d.sum(keepdims=True)]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            layers[k] = layers[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, centre, scale, layers, 1.0)
    if len(set(label[kept])) == 2:
        model.temperature = temperature_of(model.log_odds(x[kept]), label[kept])
    return model


def score_texts(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """doc_id and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def train_quality(spark: SparkSession, sf_dir: str, most: int = FIT_DOCS) -> Model | Constant:
    """Fitted on at most ``most`` labelled documents outside the held-out fold."""
    return fitted(fit, documents(spark, sf_dir), table(spark, sf_dir, "labels"), "quality", fold(5) != 0, most)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text."""
    scored = score_texts(documents(spark, sf_dir), train_quality(spark, sf_dir))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
