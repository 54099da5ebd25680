import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import linededup
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents
from tesserae.llm.linededup import MIN_WORDS, half_keys, one_edit


def brute(rows):
    """Kept text, exact and near drops of (doc_id, text) rows with distinct ids, by all earlier lines."""
    lines = [(d, k, tuple(x.lower().split())) for d, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for d, k, w in lines:
        first.setdefault(w, (d, k))
    by_size = {}
    for w in first:
        by_size.setdefault(len(w), []).append(w)

    def near(w):
        if len(w) < MIN_WORDS:
            return False
        others = [x for n in (len(w) - 1, len(w), len(w) + 1) if n >= MIN_WORDS for x in by_size.get(n, ())]
        return any(first[x] < first[w] and x != w and one_edit(list(x), list(w)) for x in others)

    exact, close = {}, {}
    for d, k, w in lines:
        if first[w] != (d, k):
            exact.setdefault(d, set()).add(k)
        elif near(w):
            close.setdefault(d, set()).add(k)
    out = {}
    for d, t in rows:
        gone = exact.get(d, set()) | close.get(d, set())
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out[d] = (kept, len(exact.get(d, ())), len(close.get(d, ())))
    return out


def test_small_table(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in linededup.dedup_lines(rows).collect()}
    assert found == brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert found[5][2] == 1 and found[4][1] == 1 and found[2][0] is None


def test_repeated_rows_and_null_ids_stay(spark, docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_exact", "n_near"]
    assert out.count() == docs.count()
    assert {r["text"] for r in out.where("doc_id = 6").collect()} == {"Licensed under the Apache License, Version 2.0."}


def test_empty_table(none):
    assert linededup.dedup_lines(none).collect() == []


def test_query_against_brute_force(spark, sf):
    want = brute([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()])
    rows = LLM_QUERIES["op2_line_dedup"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        text, exact, near = want[r["doc_id"]]
        assert (r["n_exact"], r["n_near"], r["kept_crc32"]) == (exact, near, zlib.crc32(text.encode()))


words = st.lists(st.sampled_from("abcdefgh"), min_size=MIN_WORDS, max_size=40)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(0, 40), st.sampled_from(["in", "out", "other"]), st.sampled_from("xyz"))
def test_one_edit_shares_a_half_key(line, at, how, word):
    at %= len(line)
    other = {"in": [*line[:at], word, *line[at:]], "out": line[:at] + line[at + 1 :], "other": [*line[:at], word, *line[at + 1 :]]}[how]
    assert one_edit(line, other) and one_edit(other, line)
    if len(other) >= MIN_WORDS:
        assert set(half_keys(line)) & set(half_keys(other))


def test_one_edit_is_strict():
    assert not one_edit("a b c d e".split(), "a x c y e".split())
    assert not one_edit("a b c d e".split(), "b a c d e".split())
    assert not one_edit("a b c".split(), "a b c d e".split())


def test_columns_of_any_name_are_carried_along(spark):
    df = spark.createDataFrame([(1, "a line of five words", 7, "x"), (2, "a line of five words\nrest", 8, "y")], "doc_id long, text string, `__ld_key` long, `__LD_a.b` string")
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_exact", "n_near"]
    assert {tuple(r) for r in out.collect()} == {(1, "a line of five words", 7, "x", 1, 0, 0), (2, "rest", 8, "y", 2, 1, 0)}


def test_a_template_line_with_very_many_variants(spark):
    rows = [(k, f"this line is shared by all of them but for word{k}\n{'same start of the line ' * 2} {k}") for k in range(600)]
    df = spark.createDataFrame([*rows, (900, "\n".join(t.split("\n")[0] for _, t in rows))], "doc_id long, text string").repartition(4)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in linededup.dedup_lines(df).collect()} == want
    assert want[900] == ("", 600, 0) and want[0][2] == 0 and want[599][0] == ""
