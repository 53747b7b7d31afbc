import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls, blanks, repeated rows, a long text, and columns named like outputs."""
    prose = " ".join(f"word{i % 97} and{i % 89}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, prose, "b"), (4, prose, "b"),
            (None, "no id here", "b"), (5, prose.upper(), None), (6, "naïve ☃ \U0001f600 text <|endoftext|>", "c"),
            (7, "x" * 50_000 + " " * 3000 + "y z" * 9000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"kept": F.lit(7), "size": F.lit("s"), "row": F.lit(1.5), "ids": F.lit(None).cast("int"),
                           "words": F.lit("w"), "key": F.lit("k"), "id": F.lit(0)})


@pytest.fixture(scope="module")
def no_documents(odd_documents):
    return odd_documents.limit(0)
