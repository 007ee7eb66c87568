import pytest

TRICKY = [None, "", " ", "\n", "\n\n", "word", "a\n\na\n", "é😀 ñ x \u0085y", "x " * 5000, "z" * 50_000,
          "same text of some words that is here twice " * 3, "same text of some words that is here twice " * 3]


@pytest.fixture
def tricky(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns that clash."""
    rows = [(i, t, "en", "s%d" % (i % 3), i * 10) for i, t in enumerate(TRICKY)]
    rows += [(None, "an id is missing here", None, None, None), (5, "word", "en", "s2", 50), (5, "other words", "en", "s1", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clash(df, *names):
    """The table with extra columns of these names."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
