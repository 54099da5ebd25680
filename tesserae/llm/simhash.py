"""SimHash near-duplicates: fingerprints, linked by a binary trie self-join.

A fingerprint bit is set where more than half of a text's shingle hashes have
it. Equal fingerprints are brought together first, and the fingerprint itself
stands for all of them. Two fingerprints that differ in at most ERRORS bits
agree in one of ERRORS + 1 blocks of bits, so each distinct one goes to the
tries of its blocks, ERRORS + 1 rows in all. A trie of more than TRIE_ROWS is
dealt once more: in the same way by blocks of the bits that are left. In a
block's trie (a sorted run;
a node is a range with a common prefix) node pairs are walked together: bits
that differ above both nodes' branching bits are counted, and a pair is left
as soon as they exceed ERRORS. Pairs whose ends are all linked already are
left too, so a large group of near copies costs no visit of all its pairs. A
trie gives a star of links for each group, never all pairs; components over
all stars give the classes, and a class is named by its smallest doc_id.

Defined results: a text without words (null, empty) has fingerprint 0 and
links like any other; fewer words than a shingle give one shingle of them all.
Rows with a null doc_id get a fingerprint and link like any other;
component_id is null if no row of their component has a doc_id. Repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_skewed, map_batches, materialize, shuffle_width, texts_of
from .components import components

SEED = 42
#: Differing bits up to which fingerprints link.
ERRORS = 4
#: Bytes of a text that are split into words at a time.
TEXT_BLOCK = 1 << 20
#: Rows of whole tries that a task walks together, and node pairs of one step: bound its memory.
TRIE_ROWS, PAIRS = 1 << 17, 1 << 19
#: Largest product of two ranges that is compared outright.
LEAF = 64

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAKS = b" \t\n\r\x0b\x0c"


def word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """Words, block by block; cuts fall on white space only."""
    at = 0
    while at < len(raw):
        end = min(at + TEXT_BLOCK, len(raw))
        while end < len(raw) and raw[end] not in BREAKS:
            end += 1
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, block by block."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    carry: list[bytes] = []
    some = False
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for block in word_blocks(raw):
        words = carry + block
        if len(words) >= width:
            some = True
            yield np.array([digest(join(s), SEED) for s in zip(*[words[k:] for k in range(width)], strict=False)], np.uint64)
        carry = words[-(width - 1) :] if width > 1 else []
    if not some and carry:
        yield np.array([digest(join(carry), SEED)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes have; 0 for none."""
    ones, total = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprint(text: str | None, width: int) -> int:
    return majority(shingle_hashes(text, width))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([signed(fingerprint(t, width)) for t in texts_of(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


# the trie self-join, on arrays


def _branch(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The highest bit that differs in each sorted range, as a mask; 0 for single members."""
    x = fp[lo] ^ fp[hi - 1]
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return x ^ (x >> np.uint64(1))


def _middle(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The first member of each range that has the branching bit set."""
    a, b = lo.copy(), hi.copy()
    while (going := a < b).any():
        m = (a + b) >> 1
        one = (fp[np.minimum(m, len(fp) - 1)] & bit) != 0
        b = np.where(going & one, m, b)
        a = np.where(going & ~one, m + 1, a)
    return a


class Groups:
    """Disjoint sets over 0..n-1 as a flat array of labels: the smallest member's index."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def runs(self) -> np.ndarray:
        """For each place the end of its run of equal labels: a range within a run is linked."""
        ends = np.flatnonzero(np.append(self.label[1:] != self.label[:-1], True)) + 1
        return np.repeat(ends, np.diff(ends, prepend=0))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _pivots(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: Groups, errors: int) -> None:
    """Link each trie's members to the one nearest the majority of its bits, where within reach."""
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a > LEAF:
            part = fp[a:b]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            centre = np.frombuffer(np.packbits(2 * bits > b - a).tobytes(), ">u8").astype(np.uint64)
            pivot = int(np.argmin(_distance(part, centre)))
            near = np.flatnonzero(_distance(part, part[pivot]) <= errors)
            groups.link(np.full(len(near), a + pivot), a + near)


def linked(bucket: np.ndarray, fp: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Labels that link members of a bucket (rows sorted by bucket, fp; distinct) within ``errors`` bits."""
    groups = Groups(len(fp))
    if not len(fp):
        return groups.label
    hi = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    lo = np.append(0, hi[:-1])
    next_to = np.flatnonzero((bucket[1:] == bucket[:-1]) & (_distance(fp[1:], fp[:-1]) <= errors))
    groups.link(next_to, next_to + 1)
    _pivots(fp, lo, hi, groups, errors)
    many = hi - lo > 1
    stack = [(lo[many], hi[many], lo[many], hi[many])]
    ends = groups.runs()
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if len(a0) > PAIRS:
            stack.append(tuple(x[PAIRS:] for x in (a0, a1, b0, b1)))
            a0, a1, b0, b1 = (x[:PAIRS] for x in (a0, a1, b0, b1))
        # nothing to gain where both ranges are one linked group
        whole = (ends[a0] >= a1) & (ends[b0] >= b1) & (groups.label[a0] == groups.label[b0])
        sa, sb = _branch(fp, a0, a1), _branch(fp, b0, b1)
        top = np.maximum(sa, sb)
        above = ~(top | (top - np.uint64(1))) if len(top) else top
        above = np.where(top == 0, np.uint64(0xFFFFFFFFFFFFFFFF), above)
        keep = ~whole & (np.bitwise_count((fp[a0] ^ fp[b0]) & above) <= errors)
        a0, a1, b0, b1, sa, sb = (x[keep] for x in (a0, a1, b0, b1, sa, sb))
        size_a, size_b = a1 - a0, b1 - b0
        leaf = size_a * size_b <= LEAF
        if leaf.any():
            na, nb = size_a[leaf], size_b[leaf]
            n = na * nb
            own = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[leaf][own] + k // nb[own], b0[leaf][own] + k % nb[own]
            near = (i < j) & (groups.label[i] != groups.label[j])
            i, j = i[near], j[near]
            near = _distance(fp[i], fp[j]) <= errors
            if near.any():
                groups.link(i[near], j[near])
                ends = groups.runs()
        a0, a1, b0, b1, sa, sb = (x[~leaf] for x in (a0, a1, b0, b1, sa, sb))
        if not len(a0):
            continue
        same = a0 == b0  # a node with itself; ranges are equal or apart
        ma, mb = _middle(fp, a0, a1, sa), _middle(fp, b0, b1, sb)
        s, both, left, right = same, ~same & (sa == sb), ~same & (sa > sb), ~same & (sa < sb)
        new = [
            (a0[s], ma[s], a0[s], ma[s]), (ma[s], a1[s], ma[s], a1[s]), (a0[s], ma[s], ma[s], a1[s]),
            (a0[both], ma[both], b0[both], mb[both]), (a0[both], ma[both], mb[both], b1[both]),
            (ma[both], a1[both], b0[both], mb[both]), (ma[both], a1[both], mb[both], b1[both]),
            (a0[left], ma[left], b0[left], b1[left]), (ma[left], a1[left], b0[left], b1[left]),
            (a0[right], a1[right], b0[right], mb[right]), (a0[right], a1[right], mb[right], b1[right]),
        ]
        stack.append(tuple(np.concatenate(x) for x in zip(*new, strict=True)))
    return groups.label


def blocks(errors: int, first: int = 0, end: int = 64) -> list[tuple[int, int]]:
    """(shift, bits) of errors + 1 blocks that part the bits from first to end."""
    cuts = [first + (end - first) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bits(shift: int, bits: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1)


def _part(rest: list[int], errors: int) -> list[list[int]]:
    """errors + 1 lists that part the given bits."""
    return [rest[len(rest) * k // (errors + 1) : len(rest) * (k + 1) // (errors + 1)] for k in range(errors + 1)]


def tries(distinct: DataFrame, errors: int) -> DataFrame:
    """fp and bucket: each fingerprint in the tries that it belongs to; fingerprints within ``errors`` bits share one."""
    n = errors + 1
    parts = blocks(errors)
    keys = F.array(*[_bits(*p) * n + k for k, p in enumerate(parts)])
    rows = distinct.select("fp", F.explode(keys).alias("top"))
    large = rows.groupBy("top").count().where(F.col("count") > TRIE_ROWS).select("top")
    # at most a row for each value of a block
    rows = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "top", "left")
    deeper = F.lit(None).cast("array<long>")
    for k, (shift, bits) in enumerate(parts):
        rest = _part([b for b in range(64) if not shift <= b < shift + bits], errors)
        values = [sum((F.getbit("fp", F.lit(b)).cast("long") * (1 << i) for i, b in enumerate(bs)), F.lit(0).cast("long")) * n + j for j, bs in enumerate(rest)]
        deeper = F.when(F.pmod("top", F.lit(n)) == k, F.array(*values)).otherwise(deeper)
    sub = F.when(F.col("large"), deeper).otherwise(F.array(F.lit(-1).cast("long")))
    return rows.select("fp", "top", F.explode(sub).alias("sub")).select("fp", (F.col("top") * (1 << 32) + F.col("sub")).alias("bucket"))


def links(distinct: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Stars (u, v) of fingerprints that link the classes; distinct: fp (no two alike)."""
    rows = tries(distinct, errors).repartition(shuffle_width(distinct.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            bucket, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            held, n = [(bucket[end:], fp[end:])], len(bucket) - end
            bucket, fp = bucket[:end], fp[:end].view(np.uint64)
            order = np.lexsort((fp, bucket))
            bucket, fp = bucket[order], fp[order]
            label = linked(bucket, fp, errors)
            far = np.flatnonzero(label != np.arange(end))
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["u", "v"])

        for batch in batches:
            fp, bucket = (np.array(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns)
            if not len(fp):
                continue
            held.append((bucket, fp))
            n += len(fp)
            # a trie that is not whole yet is not put together again for each batch
            if n >= TRIE_ROWS and held[0][0][0] != bucket[-1]:
                yield from flush(False)
        if n:
            yield from flush(True)

    return map_batches(rows, run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, errors: int = ERRORS) -> DataFrame:
    """doc_id, fp and component_id of each row of docs."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    classes = components(links(distinct.select("fp"), errors)).where("node <> component").withColumnRenamed("node", "fp")
    placed = distinct.join(classes, "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    placed = materialize(placed.select("fp", "rep", "class", "n"), "classes")
    # a class of one fingerprint has its name already
    shared = placed.where("class <> fp").select("class").distinct()
    several = placed.join(shared, "class", "left_semi")
    firsts = several.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = placed.join(firsts, "class", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n")
    return join_skewed(prints, materialize(named, "class-names"), ["fp"], "n").select("doc_id", "fp", "component_id")


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by shingles of four words."""
    found = near_duplicates(documents(spark, sf_dir), 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
