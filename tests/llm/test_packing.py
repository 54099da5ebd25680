import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import packing
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def check_pieces(rows, sizes, window=2048):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for doc, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == sizes[doc]
    return padding


def test_pieces_hold_the_library_ids(spark, docs):
    rows = packing.pack(docs, PATH, PATTERN).collect()
    plain = docs.collect()
    ids = expected([r["text"] for r in plain])
    sizes = defaultdict(int)
    for r, x in zip(plain, ids, strict=True):
        sizes[r["doc_id"]] += len(x)
    assert check_pieces(rows, sizes) == 0
    found = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in rows}
    for r, x in zip(plain, ids, strict=True):
        mine = sorted((s, b) for (d, s), b in found.items() if d == r["doc_id"])
        assert b"".join(b for _, b in mine) == x.tobytes()


def test_query_covers_the_table(spark, sf):
    rows = LLM_QUERIES["op1_nnls_packing"](spark, sf).collect()
    plain = documents(spark, sf).collect()
    ids = {r["doc_id"]: x for r, x in zip(plain, expected([r["text"] for r in plain]), strict=True)}
    assert check_pieces(rows, {d: len(x) for d, x in ids.items()}) == 0
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_empty_table(none):
    assert packing.pack(none, PATH, PATTERN).collect() == []


def test_plan_never_uses_more_than_there_is():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 64, 20))
        hist = rng.integers(1, 30, len(lengths))
        used = dict.fromkeys(lengths.tolist(), 0)
        for row, n in packing.plan(hist, lengths, 64):
            assert sum(row) == 64 and n > 0 and list(row) == sorted(row, reverse=True)
            for size in row:
                used[size] += n
        assert all(used[size] <= n for size, n in zip(lengths.tolist(), hist.tolist(), strict=True))


def dense(parts, n):
    a = np.zeros((n, sum(len(p) for p in parts)))
    for c, row in enumerate(r for p in parts for r in p.tolist()):
        for i in row:
            a[i, c] += 1
    return a


def test_solver_meets_the_optimum():
    """Least squares by many plain projected steps on the dense matrix."""
    rng = np.random.default_rng(1)
    for _ in range(5):
        lengths = np.unique(rng.integers(1, 40, 14))
        hist = rng.integers(1, 50, len(lengths))
        parts = packing.combinations(lengths, 40)
        if not parts:
            continue
        a = dense(parts, len(lengths))
        x = np.zeros(a.shape[1])
        for _ in range(20_000):
            x = np.maximum(x - a.T @ (a @ x - hist) / np.linalg.norm(a, 2) ** 2, 0)
        mine = np.concatenate(packing.repeat_counts(hist, parts, 5000, 1e-6))
        assert (mine >= 0).all() and np.sum((a @ mine - hist) ** 2) <= np.sum((a @ x - hist) ** 2) + 1e-3 * hist.sum()


def cut_by_greedy(lengths, hist, window):
    """Pieces that one run, longest first, cuts."""
    at = cuts = 0
    for size in sorted(np.repeat(lengths, hist).tolist(), reverse=True):
        cuts += at // window != (at + size - 1) // window
        at += size
    return cuts


def left_over(lengths, hist, planned):
    left = dict(zip(lengths.tolist(), hist.tolist(), strict=True))
    for row, n in planned:
        for size in row:
            left[size] -= n
    return np.array(list(left)), np.array(list(left.values()))


def test_planned_counts_follow_the_solved_ones():
    """Where whole combinations make up the histogram, rounding keeps nearly all that is solved."""
    rng = np.random.default_rng(4)
    every = packing.combinations(np.arange(1, 2048), 2048)[1]
    chosen, times = every[rng.choice(len(every), 300, replace=False)] + 1, rng.integers(5, 60, 300)
    lengths, hist = np.unique(np.repeat(chosen, times, axis=0), return_counts=True)
    solved = np.concatenate(packing.repeat_counts(hist, packing.combinations(lengths, 2048))).sum()
    planned = packing.plan(hist, lengths, 2048)
    assert abs(solved - times.sum()) <= 0.02 * times.sum()
    assert sum(n for _, n in planned) >= 0.9 * solved


def test_the_plan_spares_cuts():
    rng = np.random.default_rng(7)
    sizes = np.minimum(rng.lognormal(6, 1, 10_000).astype(int) % 2047 + 1, 2047)
    lengths, hist = np.unique(sizes, return_counts=True)
    left = left_over(lengths, hist, packing.plan(hist, lengths, 2048))
    # every combination needs a piece of a third of the window: hardly any is left
    assert left[1][left[0] >= 683].sum() <= 0.05 * hist[lengths >= 683].sum()
    assert cut_by_greedy(*left, 2048) <= 0.2 * cut_by_greedy(lengths, hist, 2048)


def test_large_counts_make_a_bounded_plan():
    lengths = np.arange(1, 200)
    hist = np.full(199, 10**9)
    planned = packing.plan(hist, lengths, 256)
    assert len(planned) <= packing.ROUNDS * packing.PATTERNS
    assert sum(n * sum(row) for row, n in planned) >= 0.8 * int((lengths * hist).sum())


def test_tail():
    assert packing.tail(2048 * 3, 2048) == [] and packing.tail(2048 + 13, 2048) == [(2048, 2056), (2056, 2060), (2060, 2061)]


def test_long_white_space(spark):
    texts = [" " * 1_200_000, "a" + "\n" * 5000 + "b", "x" + " " * 3000 + "<|endoftext|>" + "\u2003" * 3000 + " it's", "\t" * 1024, "a" * 100_000, " \n" * 4000 + "end  "]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, PATTERN).collect()
    for d, want in enumerate(expected(texts)):
        mine = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == d)
        assert b"".join(b for _, b in mine) == want.tobytes()


def test_one_length_of_all_rows(spark):
    """A length that very many documents share, ties and repeated rows."""
    df = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.lit("word " * 1500).alias("text"))
    rows = packing.pack(df, PATH, PATTERN).collect()
    sizes = defaultdict(int)
    n = len(expected(["word " * 1500])[0])
    for r in df.collect():
        sizes[r["doc_id"]] += n
    assert check_pieces(rows, sizes) == 0
