import pytest

#: Edge cases that every operator on documents must survive.
EDGE = [
    (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s", 6), (4, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7),
    (6, "Ünïcode wörds ñandú 日本語 text here for ever and ever", "de", "s", 0), (7, "word " * 30_000, "en", "s", 0), (8, "x" * 200_000, "fr", "s", 0), (None, "a null id has this text", "en", "s", 0),
    (9, "12 345 !!! ??? ###", "en", "s", 0),
]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names the operators use themselves
    return rows.withColumns({c: F.lit("mine") for c in ("key", "d", "h", "spans", "score", "row", "bucket", "n", "ids", "shard", "slot", "_other", "a", "b", "label", "token", "my col", "a-b", "x.y", "t`k")})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("doc_id < 0")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
