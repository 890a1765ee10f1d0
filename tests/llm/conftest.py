import pytest
from pyspark.sql import functions as F

LONG = ("the quick brown fox jumps over the lazy dog and runs away from 17 hounds. " * 4000).strip()
ROWS = [(1, "Some words, some more."), (2, None), (3, ""), (4, "   \n"), (5, "12 34 !?"), (6, LONG), (7, "Repeated text of some length, repeated."), (7, "Repeated text of some length, repeated."), (8, "Repeated text of some length, repeated."), (None, "No id at all."), (None, None), (9, "éé ñandú Straße İstanbul 中文 <|endoftext|>  it's")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the names of results."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("lang_pred", "score", "node", "name", "label", "spans", "kind", "media", "n", "start", "shard", "key", "row"):
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("lang", F.when(F.col("doc_id") != 5, "en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
