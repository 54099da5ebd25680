"""Similarity search: two stages against the exact one, ties, vectors that hold no numbers."""

import pickle
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import embed
from tesserae.operators import similarity


def found(df, query, k, mode, *places):
    return [(r["id"], r["score"]) for r in similarity.nearest(df, "v", "id", query, k, mode, *places).collect()]


@pytest.mark.parametrize(("mode", "decoys"), [("rapida", 300), ("equilibrada", 2300)])
def test_two_stages_lose_nothing(spark, mode, decoys):
    """Rows of the query's very signs that score little, and more of them than the sieve takes."""
    q = [1.0] + [0.02] * 7
    rows = [(i, [0.1] + [1.0 + i % 7] * 7) for i in range(decoys)]
    rows += [(9000, [1.0] + [-0.02] * 7), (9001, [1.0] + [-0.04] * 7), (9002, [3.0] + [0.06] * 7)]
    rows += [(9003, None), (9004, [None] * 8), (9005, [0.0] * 8), (9006, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = found(df, q, 3, mode)
    assert [i for i, _ in got] == [9002, 9000, 9001] and got == found(df, q, 3, "exacta")


def test_two_stages_on_random_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (600, 24)) * rng.uniform(0.01, 9, (600, 1)))]
    df = spark.createDataFrame(rows, "id long, v array<float>").cache()
    for i in range(2):
        assert found(df, rows[i][1], 7, "rapida") == found(df, rows[i][1], 7, "exacta")
    bad = df.union(spark.createDataFrame([(2000, [float("nan")] * 24), (2001, [float("inf")] * 24)], df.schema))
    assert [i for i, _ in found(bad, rows[0][1], 3, "rapida")] == [i for i, _ in found(bad, rows[0][1], 3, "exacta")]


def test_ties_of_the_rounded_score(spark):
    """Scores that differ beyond the places asked for are ties and go by the key."""
    q = [1.0] + [0.0] * 7
    df = spark.createDataFrame([(i, [1.0, 0.5 - i * 1e-5] + [0.0] * 6) for i in range(6)], "id long, v array<double>")
    assert [i for i, _ in found(df, q, 2, "exacta", 4)] == [0, 1] == [i for i, _ in found(df, q, 2, "rapida", 4)]
    assert [i for i, _ in found(df, q, 2, "exacta")] == [5, 4]


def plainly(text, dims):
    """The embedder's definition, chunk by chunk."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = Counter()
    for word in re.findall(r"[^\W_]+", text.strip(" \t\n\r\0\x0b").translate(lower).translate(embed.FOLD)):
        found.update([f"p:{word}", *[f"t:{word[i : i + 3]}" for i in range(len(word) - 2)]])
    v = np.zeros(dims)
    for chunk, times in found.items():
        v[zlib.crc32(chunk.encode()) % dims] += (-1.0 if zlib.crc32(b"s" + chunk.encode()) & 1 else 1.0) * times**0.5
    return v


def test_embedder_against_its_definition(monkeypatch):
    rng = np.random.default_rng(3)
    letters = list("aAbBeEéÉñÑ_ \n\0\tſİß9京")
    texts = ["", " ", "The the THE tHé", "x" * 500, "aba " * 5000, *["".join(rng.choice(letters, 80)) for _ in range(100)]]
    for most in (1 << 17, 40):  # the second forgets again and again
        monkeypatch.setattr(embed, "REMEMBER", most)
        e = embed.HashEmbedder(64)
        for text in texts:
            assert np.array_equal(e.vector(text), plainly(text, 64)), text
        assert len(e.words) <= most and all(len(w) <= embed.KNOWN_CHARS for w in e.words)
        assert not pickle.loads(pickle.dumps(e)).words


class Counted:
    """An embedder that counts what it embeds."""

    dims = 8

    def __init__(self, seen):
        self.seen = seen

    def vector(self, text):
        self.seen.add(1)
        return np.arange(8.0) + len(text)


def test_texts_are_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "ab" * i if i else None) for i in range(3000)], "id long, t string")
    rows = similarity.embedded(df, df["t"], Counted(seen), "v")
    assert len(found(rows, np.arange(8.0), 5, "exacta")) == 5
    assert seen.value == 2999
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert found(similarity.embedded(df.limit(1), df["t"], Counted(seen), "v"), np.arange(8.0), 5, "exacta") == []


def test_normalising_is_linear(spark):
    """The norm of a vector is computed once, not once a component."""
    df = spark.range(8).select("id", F.transform(F.sequence(F.lit(1), F.lit(16384)), lambda x: (x + F.col("id")).cast("float")).alias("v"))
    df.count()
    began = time.monotonic()
    got = df.select(similarity.normalised(F.col("v"))[0]).collect()
    assert time.monotonic() - began < 20
    assert got[0][0] == pytest.approx(1 / np.sqrt((np.arange(1.0, 16385) ** 2).sum()))
