"""What the Spark dialect does for speed leaves every answer as it was."""

import random
import re

import pytest
from corvane.functions import task_metrics as rules
from corvane.functions.dialect import JAVA_SPACE, SPACE, SparkSql, required
from corvane.plans import queries
from pyspark.sql import functions as F

PATTERNS = [*rules.CHOICE_ANSWER, *rules.EXPLAINED_ANSWER, *rules.STEPS, *rules.UNRELATED, rules.NAMED_HYPOTHESIS, rules.STATED_HYPOTHESIS, rules.LONE_DIGIT, *rules.EXPLICIT_HYPOTHESIS, *(p for p, _ in rules.SPECIFIC), *rules.CONCEPTUAL, *rules.QUOTED_CHOICE, *rules.PLAIN_CHOICE, *rules.LIST_MARKS, *rules.SHALLOW, *rules.CONJUNCTIONS, *rules.KNOWLEDGE, *rules.DEFINITIONS, *(p for p, _ in rules.COMPLEX), *rules.COMPARISONS]


def test_required_texts():
    assert required("a(?:bc|bd)?e+") == [frozenset("a"), frozenset("e")]
    assert required("(?:one|two)x[yz]") == [frozenset(["one", "two"]), frozenset("x"), frozenset("yz")]
    assert required("(?i)ab") == required("ab|c*") == required(r"\p{Lu}ab") == required("[^ab]") == []


def test_gates_do_not_change_matches(spark):
    rng = random.Random(7)
    pieces = sorted({t for p in PATTERNS for s in required(p) for t in s} | set("aé0_1 \n,.:\"'?-*•") | {" is a ", " are", "x", "\n\n", "  "})
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["", "the answer is: 'x'", "it is a b", " is a b", "é is a é"]
    d = SparkSql()
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(4)
    wrong = [p for p in PATTERNS if df.where(f"{d.matches('s', p)} IS DISTINCT FROM rlike(s, {d.rx(p)})").count()]
    assert wrong == []
    words = [d.at("split('is a,are,é,,0,which', ',')", i) for i in range(6)]
    assert df.where(" OR ".join(f"({d.has_word('s', w)} IS DISTINCT FROM rlike(s, {d._whole(w)}) OR {d.count_word('s', w)} IS DISTINCT FROM regexp_count(s, {d._whole(w)}))" for w in words)).count() == 0


def test_spaces_are_the_same(spark):
    chars = spark.createDataFrame([(chr(c),) for c in range(0x3100)], "c string")
    d = SparkSql()
    assert chars.where(f"rlike(c, {d.lit('^' + JAVA_SPACE + '$')}) <> rlike(c, {d.lit('^[' + SPACE + ']$')})").count() == 0


@pytest.mark.parametrize("module", ["ecare_explanation", "ecqa_negative"])
def test_a_text_is_split_once_for_a_ladder(module):
    """Each step of a ladder split the text again."""
    rule = rules.RULES["ecare_explanation", "response_brevity"][0] if module == "ecare_explanation" else rules.RULES["ecqa_negative", "atomic_sentence_format"][0]
    assert len(re.findall(r"\bsplit\(", rule(SparkSql()))) == 1


def test_task_rows_are_dealt_to_all_tasks(spark, sf_dir):
    """A table of one row group was scored by one task."""
    assert queries.task_rows(spark, sf_dir).rdd.getNumPartitions() > 8


def test_replacements_in_either_case(spark):
    texts = ["E.G. this, i.e. that Dr. X vs.", "nodr. Etc.etc.", "", "none", "e.g"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    d = SparkSql()
    assert d.replace("s", rules.ABBREVIATIONS, "").startswith("CASE WHEN")
    assert df.where(f"{d.replace('s', rules.ABBREVIATIONS, '')} <> regexp_replace(s, {d.rx(rules.ABBREVIATIONS)}, '')").count() == 0
