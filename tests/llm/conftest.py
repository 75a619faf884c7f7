import pytest


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and blank texts, repeated rows and ids, and clashing column names."""
    long = " ".join(f"w{i % 977} the of and" for i in range(6000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (None, "the quick brown fox jumps over the lazy dog again and again and then sleeps", "en", "b", None),
        (4, "the quick brown fox jumps over the lazy dog again and again and then sleeps", "en", "b", 70),
        (4, "the quick brown fox jumps over the lazy dog again and again and then sleeps", "en", "b", 70),
        (5, "é ß 漢字 \u2028 \U0001f600 <|endoftext|> 123 !!! ###", "de", "c", 20),
        (6, long, "en", None, len(long)),
        (7, "word " * 300, None, "c", 1500),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr(
        "*", "'x' AS kept", "1 AS _id", "2 AS _hash", "3 AS _removed", "4 AS _times", "5 AS _copy", "6 AS _mixture", "7 AS row", "8 AS i",
        "9 AS g", "10 AS `a.b`", "'q' AS id", "11 AS h", "12 AS s", "13 AS found", "14 AS _spans", "15 AS _h", "16 AS _n", "17 AS size_", "1 AS size", "'y' AS host", "'z' AS fingerprint", "'p' AS lang_pred", "0 AS start"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
