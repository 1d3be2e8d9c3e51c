import pytest

LINES = ["The red fox runs over the hill and far away today", "Blue birds sing in the tall tree near our old house", "Nobody knows why the river turned so cold last winter", "A quiet train passes the village every morning at six", "Fresh bread smells good in the small corner shop"]
PASSAGE = "\n".join(LINES)

# columns whose names the operators use themselves
CLASHING = "key string, score string, h string, rid string, sh string, lines_removed string, runs string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls in every column, empty and blank texts, a long text, copies, near copies, repeated rows, repeated ids."""
    from orderlore.llm.tables import workers_find_package

    workers_find_package(spark)
    long = " ".join(f"word{i % 997} other{i % 89}" for i in range(6000))
    texts = [
        (1, PASSAGE), (2, PASSAGE), (3, PASSAGE.replace("red", "grey")), (4, "short"), (5, ""), (6, None), (7, " \n\t \n"), (8, long), (8, "again eight"),
        (9, PASSAGE + "\nIts own end"), (9, PASSAGE + "\nIts own end"), (None, "no id here"), (None, None), (10, "Mail me at joe@site.org or 1.2.3.4 now"),
        (11, "café naïve 中文 😀 Ünïcode\u0085x <|endoftext|> end"), (12, "a" * 900), (13, "!!! @@@ ### 123"), (14, LINES[0] + " " + LINES[2]),
    ]
    rows = [(i, t, None if n == 3 else "en", None if n == 4 else "s", None if n == 5 else len(t or ""), *["x"] * 7) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus.schema)


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
