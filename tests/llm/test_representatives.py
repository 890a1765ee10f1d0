"""One row of each component, also where ids are null or repeated."""

from corvane.llm import jaccard

A, B, C = ("a1 a2 a3 a4 a5 a6 a7 a8", "b1 b2 b3 b4 b5 b6 b7 b8", "c1 c2 c3 c4 c5 c6 c7 c8")


def test_null_and_repeated_ids(spark):
    rows = [
        *[(None, A), (None, A), (4, A)],  # copies of a document that has an id
        *[(None, B), (None, B)],  # a component of null ids alone
        *[(2, C), (3, C), (3, "d1 d2 d3 d4 d5 d6"), (3, "d1 d2 d3 d4 d5 d6")],  # an id with two texts: the second is a component of its own
        *[(4, C)],  # the id of a representative, with the text of another's component
        *[(None, None), (None, None), (None, " "), (5, None), (5, None), (5, "")],  # without words
    ]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(4)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    want = [(4, A), (None, B), (2, C), (3, "d1 d2 d3 d4 d5 d6"), (None, None), (None, None), (None, " "), (5, None), (5, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))
