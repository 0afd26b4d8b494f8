import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, row int, score double, fp string"


@pytest.fixture
def messy(spark):
    """Documents with NULLs in every column, repeated rows and ids, long and empty texts, and clashing columns."""

    def build(texts):
        rows = [(i, t, "en", f"src{i % 3}", len(t), "x", 7, 0.5, "y") for i, t in enumerate(texts)]
        long_text = " ".join(f"word{i % 997} tail." + ("\n" if i % 40 == 0 else "") for i in range(30_000))
        rows += [
            (100, None, None, None, None, None, None, None, None),
            (101, "", "en", None, 0, "x", None, None, None),
            (102, " \n\t ", "en", "s", 4, "x", 7, 0.5, "y"),
            (103, long_text, "en", "s", len(long_text), "x", 7, 0.5, "y"),
            (None, "a text without an id", "en", "s", 20, "x", 7, 0.5, "y"),
            (None, None, None, None, None, None, None, None, None),
            (104, "the same row twice", "en", "s", 18, "x", 7, 0.5, "y"),
            (104, "the same row twice", "en", "s", 18, "x", 7, 0.5, "y"),
            (105, "one id", "en", "s", 6, "x", 7, 0.5, "y"),
            (105, "two texts", "fr", "s", 9, "x", 7, 0.5, "y"),
        ]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return build


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest test table as a DataFrame and as a list of rows."""
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return df, [r.asDict() for r in df.orderBy(F.col("doc_id")).collect()]
