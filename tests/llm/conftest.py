import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples; ``extra`` adds columns whose names clash with results."""

    def make(rows, extra=False, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(partitions)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("clash") for c in (
                "shard", "size", "fp", "component_id", "key", "target", "n", "_doc", "_id", "lang_pred", "item_id", "h", "start", "copies"
            )})
        return df

    return make


#: Nulls in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, "one two three four five six"),
    (1, "one two three four five six"),
    (2, "ONE two\tthree  four five six"),
    (3, None, None, None),
    (4, "", "en", "t"),
    (5, " \n\t ", "en", "t"),
    (None, "a null id with some words in it", "de", None),
    (None, None, None, None),
    (6, "long " * 60_000, "en", "t"),
    (7, "äöü ß 日本語 \x1c odd\x1fseparators <|endoftext|> 'S x's Σ", "de", "u"),
    (8, "tie", "fr", "u"),
    (9, "tie", "fr", "u"),
]
