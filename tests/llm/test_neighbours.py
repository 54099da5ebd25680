import numpy as np

from tesserae.llm import neighbours
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import table


def exact(ids, x, k):
    order = np.array(ids)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ q
            keep = order != i
            top = np.lexsort((order[keep], -s[keep]))[:k]
            out[i] = list(zip(order[keep][top].tolist(), s[keep][top].tolist(), strict=True))
    return out


def check(rows, ids, x, k=20):
    want = exact(ids, x, k)
    place = {i: n for n, i in enumerate(ids)}
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {q for q, w in want.items() if w}
    hit = total = 0
    for q, w in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(w) + 1))
        assert all(abs(s - x[place[i]] @ x[place[q]]) < 1e-12 for _, i, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len({i for i, _ in w} & {m[1] for m in mine})
        total += len(w)
    return hit / max(1, total)


def test_query_recall(spark, sf):
    rows = LLM_QUERIES["op6_ivfpq_search"](spark, sf).collect()
    e = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    assert check(rows, [r["vec_id"] for r in e], np.array([r["embedding"] for r in e], np.float32).astype(float)) >= 0.9


def test_copies_ties_and_vectors_left_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[10:45] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(100, None), (120, [0.0] * 8), (140, [float("nan")] * 8), (160, [None] * 8), (180, [1.0] * 3), (None, [1.0] * 8), (200, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    valid = neighbours.valid_vectors(df, "vec_id", "embedding")
    assert valid.count() == 60
    found = neighbours.search(valid, valid.where("vec_id % 20 = 0").select("vec_id"), 20).collect()
    assert check(found, list(range(60)), x.astype(float)) >= 0.9
    of_copy = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20]
    assert of_copy[:5] == [10, 11, 12, 13, 14] or x[10] @ x[10] < max(x @ x[10])


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 1.0])], "vec_id long, embedding array<float>")
    valid = neighbours.valid_vectors(df, "vec_id", "embedding")
    assert neighbours.search(valid, valid.where("vec_id % 20 = 0").select("vec_id")).count() == 4
    none = neighbours.valid_vectors(df.limit(0), "vec_id", "embedding")
    assert neighbours.search(none, none.select("vec_id")).collect() == []


def test_groups_of_near_copies_wider_than_the_short_list(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    for a in range(0, 900, 300):
        x[a : a + 300] = x[a] + rng.normal(size=(300, 32)) * 0.01
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    valid = neighbours.valid_vectors(df, "vec_id", "embedding")
    found = neighbours.search(valid, valid.where("vec_id % 20 = 0 and vec_id < 900").select("vec_id"), 20).collect()
    want = {q: {i for i, _ in w} for q, w in exact(list(range(3000)), x.astype(float), 20).items() if q < 900}
    hit = sum(r["vec_id"] in want[r["query_id"]] for r in found)
    assert hit / (20 * len(want)) >= 0.9
