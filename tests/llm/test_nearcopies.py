import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from tesserae.llm import nearcopies
from tesserae.llm.nearcopies import near_copies
from tesserae.llm.simhash import fingerprint


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    """Originals, copies with one to eight words of 200 exchanged, a large group of near copies, short and empty texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for changes in range(1, 9):
        for _ in range(4):
            base = [word() for _ in range(200)]
            out.append(" ".join(base))
            copy = list(base)
            for k in rng.sample(range(200), changes):
                copy[k] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(base)
        for k in rng.sample(range(120), 2):
            copy[k] = word()
        out.append(" ".join(copy))
    return [*out, "", None, " \n", "a b", "A  b", "a c", out[0].upper()]


def groups(sets):
    label = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
            x, y = sorted((label[a], label[b]))
            label = {d: x if v == y else v for d, v in label.items()}
    return label


def test_groups_are_the_links_of_similarity_0_8(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups({d: shingles(t) for d, t in rows})
    assert {r["doc_id"]: r["component_id"] for r in near_copies(df, 5).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, "").collect()} == set(want.values())
    # fingerprints alone keep some of these pairs apart
    far = [k for k in range(0, 64, 2) if want[k + 1] == k and (fingerprint(rows[k][1], 5) ^ fingerprint(rows[k + 1][1], 5)).bit_count() > 4]
    assert len(far) > 5


def test_null_and_repeated_ids_and_no_rows(spark, docs, none):
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 4, 5, 6, 7, None}
    assert corpus_pipeline.one_of_each(spark, none, "").collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_copies(twice, 5).collect()} == {(1, 1), (2, 1)}


def test_simhash_classes_are_candidates(spark, monkeypatch):
    """Without bands the trie's classes alone meet: links are near in bits and in shingles, not in bits alone."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for k in range(60):
        base = [word() for _ in range(400)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], word()]))]
    rows += [(500, "a b c d e " * 60), (501, "a b c d e " * 60 + "z y x w v")]  # one fingerprint, 5 of 11 shingles
    bits = {d: fingerprint(t, 5) for d, t in rows}
    near = {k for k in range(60) if (bits[2 * k] ^ bits[2 * k + 1]).bit_count() <= 4}
    assert len(near) > 20 and (bits[500] ^ bits[501]).bit_count() <= 4
    monkeypatch.setattr(nearcopies, "bands", lambda shingles: np.zeros(0, np.int64))
    found = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert found == {d: d - 1 if d < 500 and d % 2 and d // 2 in near else d for d, _ in rows}
