"""Texts come back from CSV files as they were written, also where Spark would plan other splits in the middle of a read."""

import duckdb
import pytest
from corvane.plans import queries
from corvane.sources import readers, sinks, split_csv

ODD = [None, "", " ", "\n", "\r", "\r\n", "NA", "null", "None", " x", "x ", "x\n", "\tx", "x\r", "a,b\r", "a\r\nb\rc\n", "\x01x", "\x00", "a\x00b", 'a\x00"\nb', '\x00"', '"', '""', ',"', '",', "\\", '\\"', '" \n "', "#x", "﻿x", "\uffff", "a\uffff", "two\nlines", "plain"]


@pytest.fixture
def small_splits(spark):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_odd_texts(spark, small_splits, tmp_path):
    """Blanks at the ends of a text, empty texts, marks of missing cells, carriage returns at an end, zero bytes and U+FFFF were lost."""
    rows = [(i, a, b) for i, (a, b) in enumerate([(lang, t) for t in ODD for lang in ("en", None)] + [(t, "text") for t in ODD])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.source_csv_parallel(spark, str(tmp_path)).collect()
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(queries.ORACLES["source_csv_parallel"]).fetchall())


def test_odd_names(spark, tmp_path):
    rows = list(enumerate(ODD))
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(map(tuple, queries.source_csv_round_trip(spark, str(tmp_path)).collect())) == rows


@pytest.mark.parametrize("in_splits", [True, False])
def test_exact_by_either_reader(spark, tmp_path, in_splits):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/csv", df.schema, in_splits=in_splits, exact=True).collect())) == list(enumerate(ODD))


def test_splits_are_planned_once(spark, small_splits, tmp_path, monkeypatch):
    """Spark plans splits from settings and cores of the moment; a scan with other splits than the first took texts for records."""
    rows = [(i, f"{i}\n" * 40) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/csv")
    found = split_csv.split_states

    def and_then_other_splits(*args):
        states = found(*args)
        kept = spark.createDataFrame(states.collect(), states.schema)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "330")
        return kept

    monkeypatch.setattr(split_csv, "split_states", and_then_other_splits)
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/csv", df.schema, exact=True).collect())) == rows
