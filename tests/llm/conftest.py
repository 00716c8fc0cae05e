import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Rows with nulls in every column, empty and long texts, repeated rows and ties."""
    rng = random.Random(5)
    words = "the of and que la der die und ser con alpha beta gamma delta Licensed MIT License été größe naïve".split()
    base = [rng.choice(words) for _ in range(900)]
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one", "en", "a", 3),
        (5, "one two", "en", None, 7),
        (6, " ".join(base), "en", "a", 1),
        (7, " ".join(base), "de", "a", 1),
        (7, " ".join(base), "de", "a", 1),
        (8, " ".join(base[:300] + ["changed"] + base[301:]), "de", "b", 1),
        (None, "no id here at all", "fr", "b", 1),
        (9, "Released under the MIT\nLicense. mit-license\n\nApache License!", "en", "b", 1),
        (10, "été naïve größe <|endoftext|> 日本語 \U0001f600\x00 ok ok", "fr", "b", 1),
        (11, "x" * 5000, "fr", "c", 1),
        (12, "ab " * 4000, "fr", "c", 1),
        (13, "!!! ??? 123", "fr", "c", 1),
        (14, "ONE TWO", "en", "c", 1),
    ]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200))), rng.choice(["en", "de"]), rng.choice("abc"), 1) for k in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows as a stored table with extra columns whose names clash with those used inside."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    clash = "*, 1 AS row, 'x' AS key, 2 AS fp, 3 AS block, 'y' AS digest, 4 AS ratio, 5 AS n_words, 6 AS size, 7 AS kept, 'z' AS label"
    spark.createDataFrame(odd_rows(), SCHEMA).selectExpr(*clash.split(", ")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(odd, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    odd.limit(0).write.parquet(path)
    return spark.read.schema(odd.schema).parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, None), (100, 1, 1), (101, 1, 0), (101, 1, 0)], "doc_id long, quality int, toxic int")
