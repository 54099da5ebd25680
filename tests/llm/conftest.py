import pytest

#: Documents with null and empty texts, ties, repeated rows, a null id and a column whose name clashes.
ROWS = [
    (1, "The first line of some words here\nAnother line that nobody else has at all", 7),
    (2, None, 7),
    (3, "", 7),
    (4, "The first line of some words here\nsomething quite different in this one", 7),
    (5, "The first line of many words here\nshort", 7),
    (6, "Licensed under the Apache License, Version 2.0.\nshort", 7),
    (6, "Licensed under the Apache License, Version 2.0.\nshort", 7),
    (7, "x" * 70_000 + " ünïcödé 'tis <|endoftext|> ok\n" + "lorem ipsum dolor " * 3000, 7),
    (8, " \t\n\r ", 7),
    (None, "a text whose id is null and that has several words", 7),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, shard int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
