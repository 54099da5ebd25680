import re

from tesserae.llm import licences
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licences.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(filter(None, want[4].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = LLM_QUERIES["op8_licence_scan"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    assert len(rows) == len(texts)
    check(rows, texts)
    assert any(r["labels"] != r["base_labels"] for r in rows)


def test_corners(spark, none):
    texts = {
        1: None, 2: "", 3: "MIT License mit-license MIT,LICENSE", 4: "cc by cc by cc", 5: "the mit\nlicence", 6: "KCC BY",
        7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        8: "permission is hereby granted free of charge to somebody obtaining a copy of that", 9: "é" * 1000 + " Apache License " * 2000,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    check(rows.values(), texts)
    assert rows[7]["labels"] == "mit-text" and rows[7]["score"] == 1.0 and rows[8]["labels"] == ""
    assert rows[9]["n_base"] == 2000 and rows[3]["n_base"] == 3
    assert licences.scan_licences(none).collect() == []
