"""Counts of pairs by batch: the same tokens and stems as of single texts, without a shuffle of words."""

import random

import pyarrow as pa
import pytest
from corvane.functions import ngram, ngram_batch, ngram_sql
from corvane.functions.dialect import SPACES, SparkSql
from corvane.plans import queries
from pyspark.sql import functions as F

ODD = ["a..b, ,a .-,. x--3- 5. 5, é. ². -5-,.,5", "&amp;amp; &amp;lt;x &lt;skipped&gt; &quot;q&quot;", "end-\nless a b c\x1cd", "İstanbul K ΑΣ", "'\"`{|}~ [a] (b) a/b x@y", ""]


def test_tokens_and_stems_are_those_of_single_texts(monkeypatch):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab1 .,-'\"&;\n é") for _ in range(60)) for _ in range(500)]
    monkeypatch.setattr(ngram_batch, "STEMS", 3)
    for t in [*texts, "relational happily skies yyes analogousli roll 99ing sky by"]:
        assert ngram_batch.bleu_tokens(t) == ngram.tokens_13a(t)
        assert ngram_batch.stems(t) == ngram.rouge_tokens(t)


@pytest.mark.parametrize("long", [2000, 1])
def test_counts(monkeypatch, long):
    monkeypatch.setattr(ngram_batch, "LONG", long)
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["cats", "cat", "ran", "a,", "run"]) for _ in range(rng.randrange(1, 40)))
    pairs = [(text(), text()) for _ in range(200)] + [("a", ""), ("", "a")]
    got = ngram_batch.of_batch(pa.array([True] * 202), *(pa.array(x) for x in zip(*pairs)), True).to_pylist()
    for (a, b), row in zip(pairs[:200], got):
        ours, theirs = ngram.tokens_13a(a), ngram.tokens_13a(b)
        assert [row[f"h{n}"] for n in range(1, 5)] == [sum((ngram._grams(ours, n) & ngram._grams(theirs, n)).values()) for n in range(1, 5)]
        assert row["rl"] == ngram.common_subsequence(ngram.rouge_tokens(a), ngram.rouge_tokens(b))
    assert all(set(row.values()) == {0} for row in got[200:])


def test_no_word_is_shuffled(spark, sf_dir):
    """A shuffle of words took ever longer for frequent ones."""
    rows = spark.createDataFrame([(1, "a b", "a c")], "id long, response string, expected_output string")
    assert "Exchange" not in ngram_sql.ngram_scores(rows, ["id"])._jdf.queryExecution().executedPlan().toString()


def test_dealt_rows_keep_their_number_of_tasks(spark, sf_dir):
    assert queries.spread_responses(spark, sf_dir).rdd.getNumPartitions() == 8


def test_strip_from_both_ends(spark):
    texts = [SPACES + "a b" + SPACES, SPACES, "", "a\n", *[c + "é" + c for c in SPACES], "​x​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(F.expr(SparkSql().strip("t")).alias("s")).collect()] == [t.strip() for t in texts]
