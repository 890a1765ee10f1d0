"""CSV records from splits against Python's csv module and Spark's reader for one task."""

import csv
import io

import pytest
from corvane.sources import readers, split_csv
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

FIELD = st.text(alphabet='ab",\n 5', max_size=8)


def assembled(lines, cuts, sep=","):
    """Records of physical lines that lie in splits cut at the given places, as the two scans make them."""
    edges = [0, *sorted(set(cuts)), len(lines)]
    splits = [lines[a:b] for a, b in zip(edges, edges[1:])]
    inside, out, open_parts = False, [], []
    for own in splits:
        made = split_csv.Assembler(inside, sep)
        records = [r for line in own if (r := made.add(line)) is not None]
        for kind, text in made.fragments():
            if kind == 0:
                open_parts.append(text)
                if not made.in_head:
                    out.append("\n".join(open_parts))
                    open_parts = []
        out += records
        open_parts += [t for k, t in made.fragments() if k == 1]
        for line in own:
            inside = split_csv.step(line, inside, sep)
    return out + (["\n".join(open_parts)] if open_parts else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=2, max_size=4), min_size=1, max_size=6), st.lists(st.integers(0, 40), max_size=5))
def test_records_for_every_cut(rows, cuts):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    lines = text.getvalue()[:-1].split("\n")
    got = assembled(lines, [c for c in cuts if c <= len(lines)])
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in got] == rows
    # Wherever it is cut once.
    for cut in range(len(lines) + 1):
        assert assembled(lines, [cut]) == got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a",;', max_size=14), st.booleans())
def test_state_of_a_line(line, inside):
    """The state after a line, by a plain automaton."""
    state = "in" if inside else "start"
    for ch in line:
        if state == "in":
            state = "quote" if ch == '"' else "in"
        elif state == "quote" and ch == '"':
            state = "in"
        elif ch == ",":
            state = "start"
        elif state == "start" and ch == '"':
            state = "in"
        else:
            state = "rest"
    assert split_csv.step(line, inside) == (state == "in")


ROWS = [(1, "plain", 1.5), (2, 'a "quoted" word', None), (3, "two\nlines", 2.0), (4, "ten\n" * 10 + "lines, with commas", 3.0), (5, '5" disk', 4.0), (6, None, 5.0), (7, '"', 6.0), (8, '\n"\n,"",\n', 7.0), (9, "x" * 300 + "\n" + "y" * 300, 8.0), (10, "last", 9.5)] * 20


@pytest.fixture(scope="module")
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_equal_to_the_reader_of_one_task(spark, small_splits, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, text string, value double")
    path = f"{tmp_path}/files"
    df.coalesce(2).write.options(header=True, quote='"', escape='"').csv(path)
    assert split_csv.records(spark, path).rdd.getNumPartitions() > 5
    for schema in (None, df.schema):
        whole = readers.read_csv(spark, path, schema, in_splits=False)
        split = readers.read_csv(spark, path, schema)
        assert split.dtypes == whole.dtypes
        assert sorted(split.collect(), key=repr) == sorted(whole.collect(), key=repr)
    assert split.count() == len(ROWS)
    one = f"{tmp_path}/one"
    df.coalesce(1).write.options(header=True, quote='"', escape='"').csv(one)
    in_order = readers.read_csv(spark, one, df.schema, order="at").orderBy("at").drop("at").collect()
    assert [tuple(r) for r in in_order] == [tuple(r) for r in readers.read_csv(spark, one, df.schema, in_splits=False).collect()]


def test_line_ends_headers_and_unclosed_fields(spark, small_splits, tmp_path):
    one = tmp_path / "one.csv"
    one.write_bytes(b'"long\nname",b\r\n\r\n"x\r\ny",1\r\nplain,2\r\n')
    got = readers.read_csv(spark, str(one))
    assert got.columns == ["long\nname", "b"] and sorted(map(tuple, got.collect())) == [("plain", 2), ("x\r\ny", 1)]
    # A header longer than a split, and a field that is never closed.
    two = tmp_path / "two.csv"
    two.write_text('"' + "head\n" * 100 + '",b\n1,2\n"open\nfor ever')
    rows = split_csv.records(spark, str(two)).collect()
    assert sorted((r.value, r.first) for r in rows) == sorted([('"' + "head\n" * 100 + '",b', True), ("1,2", False), ('"open\nfor ever', False)])
    semi = tmp_path / "semi.csv"
    semi.write_text('a;b\n"1;\n2";"3,4"\n')
    assert [tuple(r) for r in split_csv.read(spark, str(semi), sep=";").collect()] == [("1;\n2", "3,4")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        split_csv.read(spark, str(empty))
    only = tmp_path / "only.csv"
    only.write_text("a,b\n")
    assert split_csv.read(spark, str(only), T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])).count() == 0
