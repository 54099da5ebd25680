"""Line dedup by a deletion-neighbourhood join.

A line is its words (lower-cased, parted by white space). Lines are ordered by
(doc_id, text hash, line number), and a line goes if an earlier line has the
same words, or differs from it by one edit of a word (put in, left out or
exchanged) where both have at least MIN_WORDS words, so that 0.8 or more of it
agrees. Blank lines stay.

Equal lines meet first, by a 128-bit hash. Two lines one edit apart share the
words of one end, as long as half the shorter line at most, so keys of the two
ends tell which lines can have a partner at all; for these, and no others, the
line and all its variants with one word left out are emitted as hashed keys. Equal keys are joined through grouped minima: lines left with the
same words after deletion at the same place differ by an exchange there, and a
line that equals another's variant by a word put in. So a group of any size
yields its earliest member and never its pairs. The pair (line, earliest
partner) is then verified on the words themselves. Keys that a large part of
all rows may share (a half, a variant, a partner, a line) are joined by
``join_skewed``.

What goes from a document is a mask of bits, and its text is cut on the JVM in
time linear in its lines; only documents that lose a line meet their masks.

Defined results: null texts stay null and have 0 lines; a document all of
whose lines go keeps an empty text. Rows with equal doc_id and text count as
one document, and each gets its result. Other columns are carried along,
whatever their names, but for n_lines, n_exact and n_near, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_skewed, map_batches, materialize, spare_prefix, text_or_empty, texts_of

#: Least words of both lines of a near-duplicate pair.
MIN_WORDS = 5
#: Bits of the filters that spare rows a shuffle; their size is fixed, so with very much data they only spare less.
FILTER_BITS, KEY_BITS = 1 << 20, 1 << 22
MASK = (1 << 64) - 1
LINES = "doc_id long, th long, line_no int, h1 long, h2 long, keys array<long>"
WORDS = "doc_id long, th long, line_no int, h1 long, h2 long, words string, keys array<long>"
VARIANTS = "id long, pos int, v1 long, v2 long"


def own() -> Column:
    """A line's place in the order (doc_id, text hash, line number) as one number; null ids come first."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    rest = F.pmod("th", F.lit(10**8)) * 10**10 + F.col("line_no")
    return (doc.cast("decimal(38,0)") * F.lit(str(10**18)).cast("decimal(19,0)")).cast("decimal(38,0)") + rest.cast("decimal(19,0)")


def bit(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_pair(words: list[str]) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(" ".join(words))
    return _signed(x >> 64), _signed(x & MASK)


def _half(n: int) -> int:
    """Words of a half key of a line of n words: never more than half, in steps of 4 where there are many."""
    h = n // 2
    return h if h < 8 else h - h % 4


def half_keys(words: list[str]) -> list[int]:
    """Keys of which two lines one edit apart share at least one: ends as long as for this length and one less."""
    n = len(words)
    out = []
    for k in {_half(n), _half(n - 1)}:
        out += [_signed(xxhash.xxh3_64_intdigest(side + " ".join(p))) for side, p in (("a", words[:k]), ("z", words[n - k :]))]
    return out


def one_edit(a: list[str], b: list[str]) -> bool:
    """At most one word put in, left out or exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _in_parts(rows: Iterator[tuple], schema: str, most: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _record(held, schema)
            held = []
    if held:
        yield _record(held, schema)


def split_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with words; docs: doc_id, th and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                    for k, line in enumerate(text.lower().split("\n")):
                        if words := line.split():
                            yield doc_id, th, k, *hash_pair(words), half_keys(words) if len(words) >= MIN_WORDS else None

        yield from _in_parts(rows(), LINES)

    return map_batches(docs.select("doc_id", "th", "text"), run, LINES)


def words_where(docs: DataFrame, on: np.ndarray) -> DataFrame:
    """The words and half keys of lines of which a key's bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(on)  # KEY_BITS flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            flags = shared.value
            for batch in batches:
                for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                    for k, line in enumerate(text.lower().split("\n")):
                        words = line.split()
                        if len(words) >= MIN_WORDS:
                            keys = half_keys(words)
                            if any(flags[x % KEY_BITS] for x in keys):
                                yield doc_id, th, k, *hash_pair(words), " ".join(words), keys

        yield from _in_parts(rows(), WORDS)

    return map_batches(docs.select("doc_id", "th", "text"), run, WORDS)


def variants_of(lines: DataFrame) -> DataFrame:
    """Lines (pos -1) and their variants with the word at pos left out, by 128-bit keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for id_, h1, h2, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    words = text.split(" ")
                    yield id_, -1, h1, h2
                    for i in range(len(words)):
                        yield id_, i, *hash_pair(words[:i] + words[i + 1 :])

        yield from _in_parts(rows(), VARIANTS)

    return map_batches(lines.select("id", "h1", "h2", "words"), run, VARIANTS)


def _verified(pairs: DataFrame) -> DataFrame:
    """h1 and h2 of the lines whose words are one edit from their partner's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["h1", "h2"])

    return map_batches(pairs.select("h1", "h2", "words", "other"), run, "h1 long, h2 long")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1 and h2 of the lines that have an earlier line one edit away."""
    keyed = lines.where("keys is not null").select("h1", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")
    shared = materialize(shared, "shared-halves")
    on = np.zeros(KEY_BITS, bool)
    # at most KEY_BITS numbers
    on[shared.select(F.pmod("key", F.lit(KEY_BITS)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    found = words_where(docs, on).withColumn("own", own())
    found = materialize(found.groupBy("h1", "h2").agg(F.min("own").alias("own"), F.first("words").alias("words"), F.first("keys").alias("keys")), "line-words")
    keyed = found.select("h1", F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(shared, "key", "left_semi")
    able = join_skewed(keyed, materialize(counted, "line-halves"), ["key"], "n").select("h1").distinct()
    # ids in the lines' order: a long each, where the order itself takes three numbers
    ordered = found.drop("keys").join(able, "h1", "left_semi").orderBy("own").drop("own")
    able_lines = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "ordered-lines")

    v = materialize(variants_of(able_lines), "line-variants")
    met = v.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("pos") < 0, F.col("id"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("id"))).alias("cut"),
        F.max("id").alias("last"), F.count(F.lit(1)).alias("n"),
    ).where("least(whole, cut) < last").drop("last")
    met = materialize(join_skewed(v, materialize(met, "line-keys"), ["v1", "v2"], "n").drop("n"), "line-meetings")
    here = met.where("pos >= 0").groupBy("v1", "v2", "pos").agg(F.min("id").alias("here"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    here = materialize(here.where("here < last").drop("last"), "line-places")
    by_key = met.select("id", F.when(F.col("pos") < 0, F.col("cut")).otherwise(F.col("whole")).alias("partner"))
    by_place = join_skewed(met.where("pos >= 0"), here, ["v1", "v2", "pos"], "n").select("id", F.col("here").alias("partner"))
    nearest = by_key.union(by_place).where("partner < id").groupBy("id").agg(F.min("partner").alias("partner"))
    nearest = materialize(nearest.join(able_lines, "id"), "line-partners")
    others = able_lines.select(F.col("id").alias("partner"), F.col("words").alias("other"))
    others = others.join(nearest.groupBy("partner").agg(F.count(F.lit(1)).alias("n")), "partner")
    return _verified(join_skewed(nearest, materialize(others, "first-lines"), ["partner"], "n"))


#: Lines of a document that one number's bits stand for.
MASK_BITS = 63


def masks(gone: DataFrame) -> DataFrame:
    """doc_id, th, mask (an array of longs, a bit a line that goes), n_gone and n_exact; gone: doc_id, th, line_no and exact."""
    bit = F.expr(f"shiftleft(1L, line_no % {MASK_BITS})")
    words = gone.groupBy("doc_id", "th", F.expr(f"line_no div {MASK_BITS}").cast("int").alias("w")).agg(
        F.bit_or(bit).alias("gone"), F.bit_or(F.when(F.col("exact"), bit).otherwise(F.lit(0).cast("long"))).alias("exact")
    )
    held = words.groupBy("doc_id", "th").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "gone"))).alias("m"), F.max("w").alias("last"),
        F.sum(F.bit_count("gone")).cast("int").alias("n_gone"), F.sum(F.bit_count("exact")).cast("int").alias("n_exact"),
    )
    return held.withColumn("mask", F.expr("transform(sequence(0, last), w -> coalesce(try_element_at(m, w), 0L))")).drop("m", "last")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the lines that stay, n_lines, n_exact and n_near."""
    work = docs.drop("n_lines", "n_exact", "n_near")
    slim = work.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    lines = materialize(split_lines(slim), "lines")
    placed = lines.select("doc_id", "th", "line_no", "h1", "h2")
    groups = placed.groupBy("h1", "h2").agg(F.min(own()).alias("first"), F.count(F.lit(1)).alias("n"))
    near = materialize(near_lines(slim, lines).distinct().withColumn("near", F.lit(True)), "near-lines")
    # lines that stand once and have no partner need no decision
    decided = groups.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", "near", "n")
    gone = join_skewed(placed, materialize(decided, "line-decisions"), ["h1", "h2"], "n").withColumn("exact", own() != F.col("first")).where("exact or near")
    gone = materialize(masks(gone), "gone-lines")

    # documents that keep all lines need not meet the others: at most FILTER_BITS marks tell most of them
    p = spare_prefix(work, "__ld")
    gone = gone.select(*[F.col(c).alias(f"{p}_{c}") for c in gone.columns])
    marks = F.broadcast(gone.select(bit(f"{p}_doc_id", f"{p}_th").alias(f"{p}_bit")).distinct())
    keyed = work.withColumn(f"{p}_key", F.xxhash64(text_or_empty()))
    keyed = keyed.withColumn(f"{p}_at", bit("doc_id", f"{p}_key"))
    marked = F.col(f"{p}_at") == F.col(f"{p}_bit")
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}_doc_id")) & (F.col(f"{p}_key") == F.col(f"{p}_th"))
    cut = keyed.join(marks, marked, "left_semi").join(gone, same, "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines")
    n_exact, n_gone = F.coalesce(f"{p}_n_exact", F.lit(0)), F.coalesce(f"{p}_n_gone", F.lit(0))

    def stays(_, i):
        word = F.coalesce(F.get(F.col(f"{p}_mask"), F.floor(i / MASK_BITS).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, F.pmod(i, F.lit(MASK_BITS))) == 0

    left = F.when(n_gone > 0, F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")).otherwise(F.col("text"))
    cut = cut.select(*[(left if c == "text" else F.col(f"`{c}`")).alias(c) for c in work.columns], n_lines, n_exact.alias("n_exact"), (n_gone - n_exact).alias("n_near"))
    whole = keyed.join(marks, marked, "left_anti")
    whole = whole.select(*[F.col(f"`{c}`") for c in work.columns], n_lines, F.lit(0).alias("n_exact"), F.lit(0).alias("n_near"))
    return cut.union(whole)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and the digest of the text that stays."""
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.crc32(text_or_empty()).alias("kept_crc32")
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.octet_length(text_or_empty()).alias("kept_bytes"), kept)
