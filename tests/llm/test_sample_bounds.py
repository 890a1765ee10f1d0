from pyspark.sql import functions as F

from corvane.llm import langid, quality


def test_language_samples_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "clustered", lambda x, k: seen.append(len(x)) or x[:k])
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of a text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.pmod("id", F.lit(3)).cast("string")).alias("lang"))
    langid.fit(rows, per_language=50, sample=1000)
    assert seen == [50, 50, 50]
    seen.clear()
    langid.fit(rows, per_language=50, sample=60)
    assert seen == [20, 20, 20]
    seen.clear()
    # One id for a third of the rows: the rank bounds what the rate lets through.
    same = rows.withColumn("doc_id", F.when(F.col("lang") == "l0", 1).otherwise(F.col("doc_id")))
    langid.fit(same, per_language=50, sample=1000)
    assert max(seen) <= 50
    seen.clear()
    junk = rows.withColumn("lang", F.when(F.col("doc_id") < 2000, F.lit("en")).otherwise(F.col("doc_id").cast("string")))
    model = langid.fit(junk, languages=4)
    assert sorted(set(model.languages)) == ["2000", "2001", "2002", "en"]


def test_quality_labels_are_bounded(spark, monkeypatch):
    seen = []
    kept = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda row, cell, grade, n: seen.append(len(grade)) or kept(row, cell, grade, n))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    ratings = docs.select("doc_id", F.pmod("doc_id", F.lit(3)).cast("int").alias("grade"))
    quality.fit(docs, ratings, 3, sample=150)
    quality.fit(docs, ratings, 3, sample=5000)
    assert seen == [150, 2000]
