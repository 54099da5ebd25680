import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents
from tesserae.llm.components import components


def plain_fingerprint(text, width=4):
    low = regex.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = regex.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(fps):
    """Smallest member reachable, by comparing all pairs."""
    ids = sorted(fps)
    label = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= simhash.ERRORS and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints(docs):
    for r in docs.collect():
        for width in (1, 4, 5):
            assert simhash.fingerprint(r["text"], width) == plain_fingerprint(r["text"], width)


def test_spark_hash_agrees(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"]
    assert got == simhash.signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_long_text_in_blocks(monkeypatch):
    text = "one two three four five six seven " * 50
    want = plain_fingerprint(text)
    for block in (1, 7, 64):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
        assert simhash.fingerprint(text, 4) == want


def test_query_against_all_pairs(spark, sf):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op3_simhash_trie"](spark, sf).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents(spark, sf).collect()}
    want = classes(fps)
    assert rows.keys() == fps.keys()
    for d, r in rows.items():
        assert r["fingerprint"] == f"{fps[d]:016x}" and r["component_id"] == want[d]


def test_edges(spark, docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 8)} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(none).collect() == []


def test_trie_finds_every_class():
    rng = np.random.default_rng(2)
    for _ in range(25):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
        fp = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(1, 8))):
            fp = fp ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        fp = np.unique(fp)
        want = classes({i: int(f) for i, f in enumerate(fp)})
        assert simhash.linked(np.zeros(len(fp), np.int64), fp).tolist() == [want[i] for i in range(len(fp))]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 9), (5, 5), (None, 1), (3, 4), (4, 12)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 12: 1, 8: 8, 9: 8}
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert components(edges.limit(0)).collect() == []


def with_fingerprints(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", "fp"))
    return {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}


def test_a_null_id_links_what_it_lies_between(spark, monkeypatch):
    found = with_fingerprints(spark, monkeypatch, [(1, 0), (None, 15), (2, 255), (None, -1), (7, 1 << 40), (7, 1 << 40)])
    assert found == {(1, 0): 1, (None, 15): 1, (2, 255): 1, (None, -1): None, (7, 1 << 40): 1}


def test_large_tries_are_dealt_once_more(spark, monkeypatch):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 2**20, 400).astype(np.uint64) << np.uint64(13)  # equal in three blocks: their tries hold all
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)
    fp = np.unique(np.append(low, low ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])).view(np.int64)
    want = classes({i: int(f) & simhash_mask for i, f in enumerate(fp)})
    monkeypatch.setattr(simhash, "TRIE_ROWS", 50)
    found = with_fingerprints(spark, monkeypatch, [(i, int(f)) for i, f in enumerate(fp)])
    assert {d: c for (d, _), c in found.items()} == want


simhash_mask = (1 << 64) - 1
