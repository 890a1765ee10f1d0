"""The clustered layout against a plain computation in Python."""

import zlib
from collections import Counter

import pytest
from corvane.llm import layout, queries
from pyspark.sql import functions as F


def expected(rows, file_rows=1000):
    """(doc_id, z, position, file, touched, matching, bounds) of (doc_id, text, lang, source), by sorting and comparing all."""
    n = len(rows)
    null = lambda x: (0,) if x is None else (1, x)
    values = [(null(None if s is None else s.encode()), null(None if lang is None else lang.encode()), (1, -1 if t is None else len(t.encode())), null(None if i is None else zlib.crc32(str(i).encode()) % 365)) for i, t, lang, s in rows]
    coords = []
    for k in range(4):
        column = sorted(v[k] for v in values)
        first = {}
        for s, v in enumerate(column):
            first.setdefault(v, s)
        coords.append([16 * first[v[k]] // n for v in values])
    cells = list(zip(*coords))
    z = [int("".join(str(c[k] >> b & 1) for b in (3, 2, 1, 0) for k in range(4)), 2) for c in cells]
    order = sorted(range(n), key=lambda i: (z[i], null(rows[i][0])))
    file = {i: p // file_rows for p, i in enumerate(order)}
    held = {}
    for i in range(n):
        held.setdefault(file[i], []).append(cells[i])
    box = {f: [(min(c[k] for c in own), max(c[k] for c in own)) for k in range(4)] for f, own in held.items()}
    out = []
    for p, i in enumerate(order):
        c = cells[i]
        reach = [(c[0], c[0]), (c[1], c[1]), (c[2] - 2, c[2] + 2), (c[3] - 2, c[3] + 2)]
        meets = sum(all(lo <= b and a <= hi for (a, b), (lo, hi) in zip(own, reach)) for own in box.values())
        holds = sum(any(all(lo <= x <= hi for x, (lo, hi) in zip(own, reach)) for own in rows_) for rows_ in held.values())
        out.append((rows[i][0], z[i], p, file[i], meets, holds, ",".join(f"{a},{b}" for a, b in box[file[i]])))
    return out


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds").collect()), key=lambda r: r[2])


def test_whole_table(spark, documents, sf_dir):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    assert result(queries.op11_layout(spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("file_rows,bucket_rows", [(1, 1000), (7, 3)])
def test_small_files_and_buckets(documents, file_rows, bucket_rows):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    assert result(layout.plan(documents, file_rows, bucket_rows)) == expected(rows, file_rows)


def test_skew_ties_and_long_prefixes(spark):
    common = "https://a.host.example/" + "x" * 600
    rows = [(i % 40 if i % 3 else 7, "é" * (i % 9) if i % 5 else None, None if i % 7 == 0 else ["en", "", "en-GB"][i % 3], None if i % 11 == 0 else common + "/%d" % (i % 23 // 3) if i % 2 else common) for i in range(400)]
    rows += [(None, "a", "b", "c"), (None, None, None, None), (-5, "", "", ""), (2**63 - 1, "q", "en", "\U0001f600"), (-(2**63), "q", "en", "�")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # Rows of one (z, doc_id) are interchangeable.
    assert result(layout.plan(df, 10, bucket_rows=1)) == expected(rows, 10)
    with_cuts = layout.cuts(layout.keyed(df))
    assert all(len(x) <= 15 and x == sorted(x) for x in with_cuts.values())


def test_odd_inputs(odd_docs, no_docs):
    odd = odd_docs.withColumn("z", F.lit("z")).withColumn("position", F.lit(1)).withColumn("file", F.lit(1)).withColumn("bucket", F.lit(1))
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    assert result(layout.plan(odd, 2)) == expected(rows, 2)
    assert layout.plan(no_docs).count() == 0


def test_written_files(spark, documents, tmp_path):
    path = f"{tmp_path}/laid"
    layout.write(documents.withColumn("row", F.lit("r")), path, file_rows=30)
    back = spark.read.parquet(path)
    assert back.columns == [*documents.columns, "row"] and back.drop("row").exceptAll(documents).isEmpty()
    files = Counter(r.f for r in back.select(F.input_file_name().alias("f")).collect())
    assert back.count() == documents.count() and sorted(files.values(), reverse=True) == [30] * 6 + [20]
    want = {}
    for r in layout.plan(documents, 30).collect():
        want.setdefault(r.file, set()).add(r.doc_id)
    got = {}
    for r in back.select("doc_id", F.input_file_name().alias("f")).collect():
        got.setdefault(r.f, set()).add(r.doc_id)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
