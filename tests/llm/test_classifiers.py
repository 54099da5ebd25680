import tracemalloc
import zlib

import numpy as np

from tesserae.llm import quality, toxicity
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents, table

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label, fold, rest):
    rows = {r["doc_id"]: r for r in LLM_QUERIES[query](spark, SF).collect()}
    assert rows.keys() == {r["doc_id"] for r in documents(spark, SF).select("doc_id").collect()}
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % fold == rest) and 0 <= r["score"] <= 1
    known = [(r["doc_id"], r[label]) for r in table(spark, SF, "labels").collect()]
    return [(y, rows[d]["score"], rows[d]["predicted"]) for d, y in known if rows[d]["held_out"]]


def test_quality_on_held_out_labels(spark):
    found = held_out(spark, "op4_quality_classifier", "quality", 5, 0)
    right = sum(y == p for y, _, p in found)
    assert right >= 0.95 * len(found)
    assert all(p == (s >= 0.3) for _, s, p in found)


def test_toxicity_on_held_out_labels(spark):
    found = held_out(spark, "op7_toxicity", "toxic", 3, 1)
    assert sum(y == p for y, _, p in found) >= 0.85 * len(found)
    assert sum(p for y, _, p in found if y == 0) <= 0.03 * len(found)
    assert all(p == (s >= 0.7) for _, s, p in found)


def test_toxicity_recall_and_precision(spark):
    """Held-out toxic documents of a larger table: an answer that is always the same fails."""
    sf = "/root/testdata/sf0.1"
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("toxic is not null").select("doc_id", "text", "toxic").collect()
    out = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    model = toxicity.fit([r["text"] for r, o in zip(rows, out, strict=True) if not o], [r["toxic"] for r, o in zip(rows, out, strict=True) if not o])
    found = [(r["toxic"], model.score(r["text"]) >= toxicity.THRESHOLD) for r, o in zip(rows, out, strict=True) if o]
    caught = sum(y and p for y, p in found)
    assert caught >= 0.85 * sum(y for y, _ in found) and caught >= 0.85 * sum(p for _, p in found)


def test_every_passage_counts():
    texts, y = made(300)
    model = toxicity.fit(texts, y)
    for k in range(8):  # wherever it begins
        assert model.score("mnr " * k + "idiot worthless idiot worthless " + texts[1]) >= 0.7
    starts, ends = toxicity.windows(7)
    assert starts.tolist() == [0, 1, 2, 3] and ends.tolist() == [4, 5, 6, 7]


def plain_pooling(vectors, text):
    """Mean and spread of the tokens' vectors, token by token."""
    ids = [vectors.number.get(w, int(not w[0].isalnum())) for w in quality.tokens_of(text)]
    rows = [vectors.table[i].astype(float) for i in ids]
    mean = sum(rows) / len(rows)
    return np.concatenate([mean, np.sqrt(np.maximum(sum(r**2 for r in rows) / len(rows) - mean**2, 0))])


def test_vectors_and_pooling_against_plain_loops():
    texts, _ = made(40)
    vectors = quality.Vectors(texts)
    for t in texts[:5] + ["UNSEEN words !!", "a"]:
        assert np.allclose(vectors.pooled(vectors.ids(quality.tokens_of(t))), plain_pooling(vectors, t), atol=1e-5)
    names = list(vectors.number)
    bags = [[vectors.number.get(w, int(not w[0].isalnum())) for w in quality.tokens_of(t)] for t in texts]
    index = np.stack([quality.index_vector(w) for w in names])
    for i in (2, len(names) // 2, len(names) - 1):
        total = index[i].copy()
        for bag in bags:
            for at, word in enumerate(bag):
                if word == i:
                    total += sum(index[bag[k]] for k in range(max(0, at - quality.REACH), min(len(bag), at + quality.REACH + 1)) if k != at)
        total = np.sign(total) * np.log1p(np.abs(total)) + index[i]
        assert np.allclose(vectors.table[i], total / np.linalg.norm(total), atol=1e-5)


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(list("aeioumnrst"), rng.integers(2, 8))) for _ in range(400)]
    texts, y = [], []
    for i in range(n):
        words = [clean[k] for k in rng.integers(0, 400, 60)]
        y.append(int(i % 3 == 0))
        if y[-1]:
            for w in ("worthless", "idiot"):
                words.insert(int(rng.integers(0, 60)), w)
        texts.append(" ".join(words))
    return texts, y


def test_misspellings_share_grams():
    model = toxicity.fit(*made(300))
    assert model.score("you utter idiott and worthlesss thing") > model.score("aeiou mnr tsor nima")
    assert model.word_odds("idiots") > 0 > model.bias


def test_long_text_is_scored_to_its_end():
    texts, y = made(300)
    model = toxicity.fit(texts, y)
    assert model.score(texts[1] + " " + texts[2] * 300 + " idiot worthless idiot") >= 0.7
    assert model.score(" ".join(texts[1:3])) < 0.7


def test_a_word_without_breaks_is_made_in_parts(monkeypatch):
    """A long word's n-grams count as when made at once, in fitting and scoring, with little memory."""
    texts, y = made(60)
    texts.append("idiot worthless " + "abcde" * 500)
    y.append(1)
    want = toxicity.fit(texts, y)
    monkeypatch.setattr(toxicity, "LONG", 256)
    monkeypatch.setattr(toxicity, "COUNT", 7)
    model = toxicity.fit(texts, y)
    assert np.allclose(model.odds, want.odds) and np.isclose(model.word_odds("fghij" * 400), want.word_odds("fghij" * 400))
    monkeypatch.undo()
    tracemalloc.start()
    model.score("q" * 300_000)
    toxicity.counted_grams("ab1" * 100_000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 10_000_000 and all(len(w) <= toxicity.KNOWN_CHARS for w in model.known)


def test_texts_without_words_and_single_classes():
    for module in (quality, toxicity):
        score = (lambda m, t: m.score(t)) if module is toxicity else (lambda m, t: float(m.scores([t])[0]))
        assert score(module.fit([], []), "") == 0.5
        assert score(module.fit(["a b", "c"], [1, 1]), "x") == 1.0
        model = module.fit(*made(60))
        assert 0 <= score(model, "") <= 1


def test_null_and_empty_rows(spark, docs, none):
    texts, y = made(60)
    for module in (quality, toxicity):
        model = module.fit(texts, y)
        assert module.score_texts(docs, model).count() == docs.count()
        assert module.score_texts(none, model).collect() == []


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    assert 2.5 < quality.temperature_of(3 * z, y) < 3.6
