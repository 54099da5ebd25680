"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with edge marks), hashed to
BUCKETS rows of an embedding table; a passage is the average of its words; a
linear softmax over the average gives the classes. Table and softmax are trained
jointly in numpy by gradient descent with momentum, from a start that counts
the documents of each class which hold an n-gram. A document is toxic if one
of its passages is: training takes each document's most toxic passage, chosen
anew in each round; a last step fits the slope and shift of the log-odds to
both classes. Every passage of a whole text
is scored (each run of WIDTH words) and the largest counts.
As the model is linear in the average, a word adds one number to the log-odds,
kept in a bounded table of words; unseen spellings get theirs from n-grams,
some at a time, so a text without breaks takes no more memory than others.

Defined results: texts without words (null, empty) have the bias' score.
Without any label, or labels of one class only, every score is that class's
share (0.5 without labels). Repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, table, texts_of
from .labelled import FIT_DOCS, fitted, fold

BUCKETS, DIMS = 1 << 16, 8
GRAMS = (3, 4, 5, 6)
#: Words of a passage; a shorter text is averaged as if filled up with words of no evidence.
WIDTH = 4
#: Gradient steps on the chosen passages, and rounds of choosing.
STEPS, ROUNDS = 60, 5
#: Rates for the table, the softmax and its bias; decay of the table.
RATES, DECAY = (10.0, 0.3, 0.3), 1e-6
#: Weight of a toxic document against another.
TOXIC_WEIGHT = 3.0
#: Least and most factor by which calibration may change the log-odds.
SLOPES = (0.5, 3.0)
#: Documents without evidence that each n-gram's start counts besides.
PRIOR = 10.0
#: Words of the sample that are weighed at a time.
BLOCK = 1 << 14
#: Words remembered by a worker, and characters that such a word has at most.
REMEMBER, KNOWN_CHARS = 150_000, 64
#: N-grams of a word that are made at a time, and the largest number that counts equal ones (it fits 16 bits).
LONG, COUNT = 1 << 14, (1 << 16) - 1
THRESHOLD = 0.7
SEED = 11

words_of = re.compile(r"\w+").findall


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def gram_blocks(word: str) -> Iterator[list[int]]:
    """Buckets of the whole word and of a word's n-grams, about LONG at a time: a text can be one word."""
    marked = f"<{word}>"
    block = [_bucket(marked)]
    for n in GRAMS:
        for i in range(0, len(marked) - n + 1, LONG):
            block += [_bucket(marked[k : k + n]) for k in range(i, min(i + LONG, len(marked) - n + 1))]
            if len(block) >= LONG:
                yield block
                block = []
    if block:
        yield block


def counted_grams(word: str) -> tuple[list[int], list[int]]:
    """Buckets of a word's n-grams and how often each counts, at most COUNT; a long word's equal ones meet, so they are few."""
    if len(word) <= LONG // len(GRAMS):
        found = [g for block in gram_blocks(word) for g in block]
        return found, [1] * len(found)
    times = np.zeros(BUCKETS, np.int64)
    for block in gram_blocks(word):
        times += np.bincount(block, minlength=BUCKETS)
    rows = -(-times // COUNT)
    found = np.repeat(np.arange(BUCKETS), rows)
    full = np.full(len(found), COUNT)
    full[np.cumsum(rows)[rows > 0] - 1] = (times - (rows - 1) * COUNT)[rows > 0]
    return found.tolist(), full.tolist()


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of n words: one at every word that WIDTH words begin with."""
    if n <= WIDTH:
        return np.array([0]), np.array([n])
    starts = np.arange(n - WIDTH + 1)
    return starts, starts + WIDTH


class Model:
    """Embeddings and softmax; ``word_odds`` is what a word adds to a passage's log-odds."""

    def __init__(self, table: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> None:
        self.odds = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])
        self.known: dict[str, float] = {}

    def word_odds(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            total, n = 0.0, 0
            for block in gram_blocks(word):
                total += self.odds[block].sum()
                n += len(block)
            found = float(total / n)
            if len(word) <= KNOWN_CHARS:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[word] = found
        return found

    def log_odds(self, text: str) -> float:
        words = words_of(text.lower())
        if not words:
            return self.bias
        sums = np.append(0.0, np.cumsum([self.word_odds(w) for w in words]))
        a, b = windows(len(words))
        return self.bias + float((sums[b] - sums[a]).max()) / WIDTH

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -50, 50))))


class Constant:
    def __init__(self, share: float) -> None:
        self.share = share

    def score(self, text: str) -> float:
        return self.share


def _sums(values: np.ndarray, take: np.ndarray, at: np.ndarray, n: int, times: np.ndarray | None = None) -> np.ndarray:
    """The rows that ``take`` names of values, ``times`` each (once without it), summed where ``at`` puts them, one column at a time."""
    return np.stack([np.bincount(at, column[take] if times is None else column[take] * times, n) for column in values.T], 1)


def fit(texts: list[str], y: list[int], seed: int = SEED) -> Model | Constant:
    if len(set(y)) < 2:
        return Constant(float(y[0]) if y else 0.5)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    bags = [np.array([number.setdefault(w, len(number)) for w in words_of(t.lower())] or [number.setdefault("", len(number))], np.int32) for t in texts]
    flat, count, bounds = array("H"), array("H"), array("q", [0])  # BUCKETS numbers fit 16 bits
    for w in number:
        for to, found in zip((flat, count), counted_grams(w), strict=True):
            to.extend(found)
        bounds.append(len(flat))
    del number
    gram, count, bounds = np.frombuffer(flat, np.uint16), np.frombuffer(count, np.uint16), np.frombuffer(bounds, np.int64)
    sizes, totals = np.diff(bounds), np.add.reduceat(count, bounds[:-1], dtype=np.int64)
    label = np.array(y)
    share = np.array([1 - label.mean(), label.mean()])

    # start: how much likelier a text with this n-gram is toxic, rare n-grams drawn towards no evidence
    held = np.zeros((2, BUCKETS))
    for bag, k in zip(bags, label, strict=True):
        held[k, np.unique(np.concatenate([gram[bounds[w] : bounds[w + 1]] for w in np.unique(bag)]))] += 1
    odds = np.log((held[1] + PRIOR * share[1]) / share[1]) - np.log((held[0] + PRIOR * share[0]) / share[0])
    emb = rng.normal(0, 0.01, (BUCKETS, DIMS))
    emb[:, 0] = odds
    soft = rng.normal(0, 0.01, (DIMS, 2))
    soft[0] = -0.5, 0.5
    params, speed = [emb, soft, np.log(share)], [0.0, 0.0, 0.0]
    one_hot, weight = np.eye(2)[label], np.where(label == 1, TOXIC_WEIGHT, 1.0) / len(label)

    def train(chosen: list[np.ndarray]) -> None:
        word, bag = np.concatenate(chosen), np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        there, word = np.unique(word, return_inverse=True)
        o = np.repeat(np.arange(len(there)), sizes[there])
        first = np.repeat(bounds[there] - np.append(0, np.cumsum(sizes[there])[:-1]), sizes[there])
        at = first + np.arange(len(o))
        g, times = gram[at], count[at].astype(float) if count[at].max() > 1 else None
        inverse = 1 / totals[there]
        for _ in range(STEPS):
            emb, soft, bias = params
            vectors = _sums(emb, g, o, len(there), times) * inverse[:, None]
            mean = _sums(vectors, word, bag, len(chosen)) / WIDTH
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - one_hot) * weight[:, None]
            d_words = _sums(d @ soft.T, bag, word, len(there)) * (inverse / WIDTH)[:, None]
            grads = [_sums(d_words, o, g, BUCKETS, times) + DECAY * emb, mean.T @ d, d.sum(0)]
            for k, grad in enumerate(grads):
                speed[k] = 0.9 * speed[k] - RATES[k] * grad
                params[k] = params[k] + speed[k]

    def tops() -> tuple[list[np.ndarray], np.ndarray]:
        """Each document's most toxic passage and what its words add to the log-odds."""
        emb, soft, _ = params
        of_gram, of_word = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), np.empty(len(sizes))
        for i in range(0, len(sizes), BLOCK):
            at = bounds[i : i + BLOCK + 1]
            odds_there = of_gram[gram[at[0] : at[-1]]] * count[at[0] : at[-1]]
            of_word[i : i + BLOCK] = np.add.reduceat(odds_there, at[:-1] - at[0]) / totals[i : i + BLOCK]
        chosen, odds = [], []
        for b in bags:
            starts, ends = windows(len(b))
            sums = np.append(0.0, np.cumsum(of_word[b]))
            k = int(np.argmax(sums[ends] - sums[starts]))
            chosen.append(b[starts[k] : ends[k]])
            odds.append(float(sums[ends[k]] - sums[starts[k]]) / WIDTH)
        return chosen, np.array(odds)

    for _ in range(ROUNDS):
        train(tops()[0])
    emb, soft, _ = params
    slope, shift = calibrated(tops()[1], label)
    return Model(emb, soft * slope, np.array([0.0, shift]))


def calibrated(odds: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (within SLOPES) and shift of log-odds that fit both classes, each of equal weight in all."""
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    best = (np.inf, 1.0, 0.0)
    for slope in np.linspace(*SLOPES, 16):
        shift = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -50, 50)))
            shift -= float(np.clip((weight @ (p - label)) / max(weight @ (p * (1 - p)), 1e-4), -2, 2))
        z = slope * odds + shift
        loss = float(weight @ np.logaddexp(0, np.where(label == 1, -z, z)))
        best = min(best, (loss, float(slope), shift))
    return best[1:]


def score_texts(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """doc_id and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def train_toxicity(spark: SparkSession, sf_dir: str, most: int = FIT_DOCS) -> Model | Constant:
    """Fitted on at most ``most`` labelled documents outside the held-out fold."""
    return fitted(fit, documents(spark, sf_dir), table(spark, sf_dir, "labels"), "toxic", fold(3) != 1, most)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text."""
    scored = score_texts(documents(spark, sf_dir), train_toxicity(spark, sf_dir))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
