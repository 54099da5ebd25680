from collections import Counter

import corpus_pipeline
from tesserae.llm import quality, toxicity
from tesserae.llm.common import documents
from tesserae.llm.packing import pack_documents

from .test_linededup import brute
from .test_packing import check_pieces
from .test_simhash import classes, plain_fingerprint


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = corpus_pipeline.good_quality(spark, docs, sf)
    model = quality.train_quality(spark, sf)
    want = {d for d, t in rows.items() if model.scores([t])[0] >= quality.THRESHOLD}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want

    clean = corpus_pipeline.not_toxic(spark, good, sf)
    model = toxicity.train_toxicity(spark, sf)
    want = {d for d in want if model.score(rows[d]) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in clean.collect()} == want

    lines = corpus_pipeline.unique_lines(spark, clean, sf)
    kept = {d: t for d, (t, _, _) in brute([(d, rows[d]) for d in want]).items()}
    assert lines.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    one = corpus_pipeline.one_of_each(spark, lines, sf)
    label = classes({d: plain_fingerprint(t, corpus_pipeline.SHINGLE) for d, t in kept.items()})
    assert {r["doc_id"] for r in one.collect()} == set(label.values())

    sizes = {r["doc_id"]: r["doc_tokens"] for r in pack_documents(one).collect()}
    last = corpus_pipeline.packed(spark, one, sf).collect()
    assert set(sizes) == set(label.values())
    assert check_pieces(last, sizes) == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_on_odd_rows(spark, docs, none, sf):
    """Null and empty texts, a null id, repeated rows, a very long text and a column of another table's name."""
    rows = rows_of(docs)
    at = docs.columns.index("text")
    model = quality.train_quality(spark, sf)
    good = corpus_pipeline.good_quality(spark, docs, sf)
    assert good.schema == docs.schema
    assert rows_of(good) == Counter({r: n for r, n in rows.items() if model.scores([r[at] or ""])[0] >= quality.THRESHOLD})

    model = toxicity.train_toxicity(spark, sf)
    clean = corpus_pipeline.not_toxic(spark, docs, sf)
    assert clean.schema == docs.schema
    assert rows_of(clean) == Counter({r: n for r, n in rows.items() if model.score(r[at] or "") < toxicity.THRESHOLD})

    lines = corpus_pipeline.unique_lines(spark, docs, sf)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert [r["text"] for r in lines.where("doc_id in (2, 3)").orderBy("doc_id").collect()] == [None, ""]

    # 2, 3 and 8 have no words and are one group; rows of one id are one document; a row without an id stays
    one = corpus_pipeline.one_of_each(spark, docs, sf)
    assert one.columns == docs.columns
    assert rows_of(one) == Counter({r: n for r, n in rows.items() if r[0] not in (3, 8)})

    last = corpus_pipeline.packed(spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == {r[0] for r in rows}

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_run_on_odd_and_empty_tables(spark, docs, none, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, rows, marks in (("odd", docs, labels), ("empty", none, labels.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:3] == ["doc_id", "start", "length"]
        # a fit on rows of one class, or of none, keeps texts too
        assert bool(out.count()) == (name == "odd")
