import pytest

SHAPE = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, row STRING, w INT, k INT, n INT, ck LONG, comp LONG"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "src0", None if t is None else len(t), "r", 1, 2, 3, 4, 5) for i, t, lang in rows], SHAPE)


LONG = " ".join(f"word{i % 977}" for i in range(40_000))

#: Nulls, blanks, long texts, repeated rows, and one id with two texts.
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "en"), (5, "same text here", "de"), (5, "same text here", "de"), (6, "one", "en"), (6, "two", "en"), (None, "same text here", None), (7, "ünïcode ☃ 𝒳 text", "fr"), (8, "a" * 5000, "en")]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
