import pytest

from gridloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, `kept` string"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(6000))
    rows = [
        (1, "a b c d e f", "en", "s1", 11, 1, "x"),
        (1, "a b c d e f", "en", "s1", 11, 1, "x"),
        (None, None, None, None, None, None, None),
        (2, "", "en", None, 0, 2, None),
        (3, " \t\n", "de", "s2", 3, 3, "y"),
        (4, "abcdef", None, "s2", 6, None, "z"),
        (5, long, "en", "s1", len(long), 5, "q"),
        (6, long + " ", "en", "s1", len(long) + 1, 5, "q"),
        (None, "a b c d e f", "fr", "s3", 11, 1, None),
        (7, "mail a.b@c.org, +1 (487) 555-7209 or 4736962573099581 at 129.38.82.176", "en", "s1", 60, 9, "p"),
        (8, "é ü 漢字 🙂", "fr", "s1", 9, 9, "p"),
    ]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
