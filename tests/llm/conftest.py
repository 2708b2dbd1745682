import pytest
from pyspark.sql import Row


@pytest.fixture(scope="module")
def make(spark):
    """Rows of dictionaries -> a frame of the given schema, in three partitions."""

    def build(schema, rows):
        return spark.createDataFrame([Row(**r) if isinstance(r, dict) else r for r in rows], schema).repartition(3)

    return build


@pytest.fixture(scope="module")
def docs(make):
    """The cases every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    words = [f"wort{i * 7919 % 1000}" for i in range(20_000)]
    base = " ".join(words[:300])
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, base.replace("wort0", "anders"), None, None, 3), (4, None, "en", "a", 4),
            (5, "", "de", "b", 5), (6, " ".join(words), "en", None, 6), (7, " \n\t", None, "b", 7), (8, "zwei Worte", "de", "b", 8),
            (8, "zwei Worte", "de", "b", 8), (9, "!!! 123", "en", "a", 9), (10, " ".join(f"neu{i}" for i in range(80)) + " " + " ".join(words[300:360]), "en", "a", 10),
            (None, "ohne Nummer und Namen aber mit Text", "de", "b", 11)]
    return make("doc_id long, text string, lang string, source string, n_chars long, key int, id string, n int",
                [(*r[:5], 1, "x", 2) for r in rows])
