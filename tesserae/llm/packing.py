"""Packing documents into fixed windows by non-negative least squares.

Of a document's tokens, every full window is a sequence by itself; what is
left (1 to window-1 tokens) is a piece that counts in the table's histogram h
of piece lengths, window-1 numbers at most. The driver plans on it alone: the
shallow combinations of two or three lengths that fill a window exactly are
the columns of A, and repeat counts x >= 0 with least |A x - h|^2 are found by
accelerated projected gradients, until the projected gradient is TOLERANCE of
what it was at x = 0 (or after STEPS). Counts are rounded so that what is cut
off one is carried to the next, and never use more pieces than there are; what
rounding leaves is solved for again, up to ROUNDS times. The residual pieces
are packed greedily, longest first, into one run of tokens that is cut at each
window's end, and its last tokens into sequences whose lengths are powers of
two, which need no padding.

Pieces are numbered within their length (in SLICES parts each, so that a length
that very many documents share is no task by itself), and a piece's number
alone gives its place: in a planned combination, or in the run. Nothing but
the histogram and the counts of the parts reaches the driver.

Defined results: null and empty texts are the end token alone. Each token lies
in exactly one piece. Repeated rows are packed each. sequence_id is unique
over the table; offsets in a sequence are gapless from 0. An empty table gives
no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPACE, byte_alphabet
from .common import documents, give_back, map_batches, materialize, texts_of

WINDOW = 2048
#: The id that ends a document.
END = 1
#: The solver stops at this part of the first projected gradient, or after so many steps.
TOLERANCE, STEPS = 1e-3, 600
#: Solutions in turn: each one's rounding leaves pieces to the next.
ROUNDS = 4
#: Planned combinations at most; with more sequences than that, counts are rounded to multiples.
PATTERNS = 1 << 14
#: Parts in which the pieces of a length are numbered.
SLICES = 256
#: White space of this length is a piece that the splitting pattern need not look at.
LONG_SPACE = 1024
PIECES = "doc_id long, uid long, start long, length long, ids binary, doc_tokens long"


# the plan, on a histogram


def combinations(lengths: np.ndarray, window: int) -> list[np.ndarray]:
    """Pairs and triples of the given sorted lengths that sum to the window, as rows of indexes."""
    where = np.full(window + 1, -1, np.int64)
    where[lengths] = np.arange(len(lengths))
    b = window - lengths
    ok = (lengths <= b) & (where[b] >= 0)
    pairs = np.stack([np.flatnonzero(ok), where[b[ok]]], axis=1)
    triples = [np.zeros((0, 3), np.int32)]
    for i in range(len(lengths)):
        c = window - lengths[i] - lengths[i:]
        j = np.flatnonzero((c >= lengths[i:]) & (where[np.clip(c, 0, window)] >= 0))
        triples.append(np.stack([np.full(len(j), i), j + i, where[c[j]]], axis=1).astype(np.int32))
    triples = np.concatenate(triples)
    return [p for p in (pairs, triples) if len(p)]


def repeat_counts(hist: np.ndarray, parts: list[np.ndarray], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """x >= 0 with least |A x - hist|, where a row of parts names the lengths of one combination."""
    n, total = len(hist), float(hist.sum())
    h = hist / total

    def made(x: list[np.ndarray]) -> np.ndarray:
        return sum((np.bincount(p[:, k], v, n) for p, v in zip(parts, x, strict=True) for k in range(p.shape[1])), np.zeros(n))

    def back(r: np.ndarray) -> list[np.ndarray]:
        return [sum((r[p[:, k]] for k in range(1, p.shape[1])), r[p[:, 0]]) for p in parts]

    size = lambda v: float(sum((x * x).sum() for x in v)) ** 0.5
    v = [np.ones(len(p)) for p in parts]
    for _ in range(12):  # the largest curvature
        norm = size(v)
        v = back(made([x / norm for x in v]))
    rate = 1 / (1.05 * size(v))
    x = [np.zeros(len(p)) for p in parts]
    ahead, t, first = x, 1.0, None
    for _ in range(steps):
        slope = back(made(ahead) - h)
        new = [np.maximum(a - rate * g, 0) for a, g in zip(ahead, slope, strict=True)]
        moved = size([a - b for a, b in zip(new, ahead, strict=True)])
        first = first or moved
        speed = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = [a + (t - 1) / speed * (a - b) for a, b in zip(new, x, strict=True)]
        x, t = new, speed
        if moved <= tolerance * first:
            break
    return [a * total for a in x]


def rounded(x: np.ndarray, rows: np.ndarray, left: np.ndarray) -> list[tuple[int, int]]:
    """(row, count) with counts that add up to x's, as far as pieces are left (which are taken off).

    rows are in the order of their longest length, so what is carried stays with the lengths it was solved for.
    """
    unit = max(1, int(left.sum()) // PATTERNS)
    out, carry, stock = [], 0.0, left.tolist()
    at = np.flatnonzero(x > 0)
    for k, wanted, row in ((int(k), float(x[k]), rows[k]) for k in at):
        carry += wanted
        n = int(carry / unit + 0.5) * unit
        if n <= 0:
            continue
        row = [i for i in row.tolist() if i >= 0]
        n = min(n, *(stock[i] // row.count(i) for i in row))
        if n > 0:
            for i in row:
                stock[i] -= n
            out.append((k, n))
            carry -= n
        carry = min(carry, 2.0 * unit)
    left[:] = stock
    return out


def plan(hist: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations (as lengths, longest first) and how often each is filled, never more than there is."""
    left, out = hist.astype(np.int64).copy(), []
    for _ in range(ROUNDS):
        there = np.flatnonzero(left)
        parts = combinations(lengths[there], window)
        if not parts:
            break
        x = np.concatenate(repeat_counts(left[there], parts))
        rows = np.concatenate([np.pad(there[p], ((0, 0), (3 - p.shape[1], 0)), constant_values=-1) for p in parts])
        order = np.lexsort((rows[:, 1], -rows[:, 2]))
        found = rounded(x[order], rows[order], left)
        out += [(tuple(int(lengths[i]) for i in rows[order[k]][::-1] if i >= 0), n) for k, n in found]
        if not found:
            break
    return out


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], dict[int, int], int]:
    """(length, from, to, sequence, offset): where the pieces of each number go; pieces used a length; sequences."""
    out, used, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for size in lengths:
            at = used.get(size, 0)
            out.append((size, at, at + n, sequence, offset))
            used[size], offset = at + n, offset + size
        sequence += n
    return out, used, sequence


def tail(total: int, window: int) -> list[tuple[int, int]]:
    """The last tokens of a run that do not fill a window, cut into powers of two."""
    at, out = total - total % window, []
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        out.append((at, at + size))
        at += size
    return out


# tokens


class Encoder:
    """The byte-level vocabulary of a tokenizers file: the ids that the library gives."""

    def __init__(self, path: str, pattern: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.model = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.long_space = re.compile(f"{SPACE}{{{LONG_SPACE},}}")
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")")

    def ids(self, text: str) -> np.ndarray:
        if not self.long_space.search(text):
            return self.model.encode_to_numpy(text, allowed_special="all")
        # the pattern goes back over long white space step by step, so that is cut out: a piece by itself
        # but for its last character, which goes with what follows
        out = [np.zeros(0, np.uint32)]
        for part in self.find_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
                continue
            at = 0
            for m in self.long_space.finditer(part):
                end = m.end() - (m.end() < len(part))
                out.append(self.model.encode_to_numpy(part[at : m.start()], disallowed_special=()))
                out.append(np.array(self.model._encode_single_piece(part[m.start() : end]), np.uint32))
                at = end
            out.append(self.model.encode_to_numpy(part[at:], disallowed_special=()))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, pattern)


def tokenised(docs: DataFrame, path: str, pattern: str, window: int) -> DataFrame:
    """A row a full window and a row for what is left of a document; uid is unique over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(path, pattern), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.append(enc.ids(text), np.uint32(END)).astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, uid, start, len(part), part.tobytes(), len(ids)))
                    uid += 1
            for i in range(0, len(rows), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2048], strict=True), types, strict=True)], names)

    return map_batches(docs.select("doc_id", "text"), run, PIECES)


# places


def _numbered(rest: DataFrame) -> DataFrame:
    """rest with ``number``: from 0 within each length."""
    rest = rest.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(SLICES)).cast("int"))
    counts = rest.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))  # a row for each part of each length
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = rest.withColumn("number", F.row_number().over(Window.partitionBy("length", "slice").orderBy("uid")) - 1)
    return within.join(F.broadcast(counts), ["length", "slice"]).withColumn("number", F.col("number") + F.col("before")).drop("slice", "before")


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """A row a piece, with its ids as little-endian unsigned 32-bit numbers; docs: doc_id and text."""
    spark = docs.sparkSession
    pieces = materialize(tokenised(docs, path, pattern, window), "pieces")
    full, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    found = sorted((r["length"], r["n"]) for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())  # window - 1 rows at most
    lengths, hist = np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)
    places, used, sequences = intervals(plan(hist, lengths, window))
    give_back()

    # what the plan leaves of each length stands in the run from ``base`` on, longest first
    runs, total = [], 0
    for size, n in reversed(found):
        runs.append((size, used.get(size, 0), total))
        total += size * (n - used.get(size, 0))
    ends = tail(total, window)
    whole = total // window

    runs = spark.createDataFrame(runs, "length long, used long, base long")
    # 3 * ROUNDS * PATTERNS rows at most
    columns = np.array(places, np.int64).reshape(-1, 5).T
    places = spark.createDataFrame(pa.table([pa.array(c) for c in columns], ["length", "lo", "hi", "sequence", "place"]))
    at = _numbered(rest).join(F.broadcast(runs), "length")
    inside = (at["length"] == places["length"]) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    at = at.join(F.broadcast(places), inside, "left").drop(places["length"])
    at = at.withColumn("a", F.expr("base + (number - used) * length")).withColumn("b", F.col("a") + F.col("length"))
    last = ", ".join(f"named_struct('lo', {a}L, 'hi', {b}L)" for a, b in ends)
    cuts = f"if(a < {whole * window}, transform(sequence(a div {window}, least((b - 1) div {window}, {whole - 1}L)), s -> named_struct('lo', s * {window}L, 'hi', (s + 1) * {window}L)), array())"
    cuts = f"concat({cuts}, filter(array({last}), t -> t.hi > a and t.lo < b))" if ends else cuts
    cuts = f"if(lo is null, {cuts}, array(named_struct('lo', a, 'hi', b)))"
    at = at.withColumn("cut", F.explode(F.expr(cuts))).withColumn("skip", F.expr("greatest(cut.lo - a, 0L)"))
    at = at.withColumn("n", F.expr("least(b, cut.hi) - a - skip"))
    # full windows have even numbers, the plan's sequences and the run's odd ones
    sequence = F.expr(f"if(lo is null, 2 * ({sequences}L + cut.lo) + 1, 2 * (sequence + number - lo) + 1)")
    rows = at.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"), F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * n as int))").alias("ids"),
        "doc_tokens", sequence.alias("sequence_id"), F.expr("if(lo is null, a + skip - cut.lo, place)").alias("offset"),
    )
    return full.select("doc_id", "start", "length", "ids", "doc_tokens", (2 * F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).union(rows)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of docs by the byte-level vocabulary, with the digest of their ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, sf_dir))
