import pytest

LONG_WORD = "x" * 120_000
LONG_TEXT = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old stone wall"


def odd_rows():
    """Nulls in every column, empty, blank, very long, repeated and tied rows."""
    return [
        (1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, PROSE + " today", "en", "a", None),
        (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \t\n\x0b ", "en", None, 4), (6, "12 34 !!", "de", None, 8),
        (None, "une phrase sans numero", "fr", "c", 3), (7, LONG_WORD, "en", "c", 9), (8, LONG_TEXT, "en", "c", 9),
        (9, "é😀 ñandú\nline two here is a line\nline two here is a line", "es", "c", 1), (10, None, None, None, None),
        (11, "a\nb\n\nb\n \nc", "en", "a", 1), (11, "other text of the same id", "en", "a", 1),
    ]


# names that the operators use inside
EXTRA = ("rid", "size", "node", "kept", "label", "m", "piece", "__words")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.select("*", *[F.lit(f"extra {c}").alias(c) for c in EXTRA])
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
