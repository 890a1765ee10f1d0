"""What one task reads of a table that is written as CSV does not grow with the table."""

import glob

from corvane.plans import queries
from pyspark.sql import functions as F


def test_a_file_for_each_split(spark, sf_dir, tmp_path, monkeypatch):
    """Four tasks read the whole table before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(7).write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "new_path", lambda spark, tag: f"file://{tmp_path}/{tag}")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = queries.source_csv_parallel(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(glob.glob(f"{tmp_path}/csv/*.csv")) >= 7
    assert sorted(map(str, got)) == sorted(map(str, docs.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha")).collect()))
