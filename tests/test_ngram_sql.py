"""n-gram metrics of columns against the plain ones of single texts."""

import random

import numpy as np
import pytest
from corvane.functions import ngram, ngram_sql, subsequence
from corvane.functions.core_metrics import made_once
from pyspark.sql import functions as F

TEXTS = ["", " ", "the cat sat on the mat", "The cats were sitting on the mats, happily.", 'He said: "it\'s 3.5%, ok"- then\nleft', "a a a a a a b", "a a b b a a", "<skipped>", "x &amp; y &lt;z&gt; 1,000.5 -7 end-\nless", "été l'école 42nd 3-4", "running runner ran runs relational conditional valenci digitizer analogousli", None, "word " * 300 + "end", "one two three four five six seven"]


def plain(response, reference, ok):
    if not ok:
        return (0.0,) * 4
    response, reference = (response or "").strip(), (reference or "").strip()
    if not response or not reference:
        return (float(response == reference),) * 4
    return ngram.bleu(response, reference), *ngram.rouge(response, reference)


def test_columns_are_the_plain_metrics(spark):
    rows = [(i, a, b, (i % 17) != 0) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    rows += [(None, "a b c", "a b d", True), (5, "a b c", "a b d", True), (5, "a b c", "a b d", True)]
    df = spark.createDataFrame(rows, "id long, response string, expected_output string, success boolean").withColumn("word", F.lit("w")).withColumn("ng_a", F.lit(1))
    got = sorted((repr(r.id), round(r.bleu, 9), round(r.rouge1_f, 9), round(r.rouge2_f, 9), round(r.rougeL_f, 9)) for r in ngram_sql.ngram_scores(df, ["id"]).collect())
    assert got == sorted((repr(i), *(round(x, 9) for x in plain(a, b, ok))) for i, a, b, ok in rows)
    assert ngram_sql.ngram_scores(df.where("id = -1"), ["id"]).count() == 0


def test_stems_of_many_words(spark, sf_dir):
    odd = "skies dying news howe succeed agreed feed plastered bled motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky flies dies mules owned yyes sayying toy enjoyed relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll ionalli nationalli geologi theologi ties spied aed ing bying abcd123 99ing".split()
    words = sorted({w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in ngram.re.findall("[a-z0-9]+", (r.text or "").lower())} | set(odd))
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    got = {r.word: r.stem for r in made_once(df, {"stem": ngram_sql.Stems(spark=True).stem("word")}).collect()}
    assert {w: s for w, s in got.items() if s != ngram.stemmed(w)} == {}


def table_of(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("held", [subsequence.HELD, 4000])
def test_common_subsequences(monkeypatch, held):
    monkeypatch.setattr(subsequence, "HELD", held)
    rng = random.Random(6)
    pairs = []
    for _ in range(250):
        kinds = rng.choice([1, 2, 5, 40])
        side = lambda: np.array([rng.randrange(kinds) * 7**20 for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))], np.int64)
        pairs.append((side(), side()))
    assert subsequence.lengths(pairs).tolist() == [table_of(a.tolist(), b.tolist()) for a, b in pairs]


def test_long_texts_end_soon():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 20_000), rng.integers(0, 500, 20_000)
    kept = np.sort(rng.permutation(20_000)[:15_000])
    assert subsequence.lengths([(a, a[kept]), (a, b)])[0] == 15_000
