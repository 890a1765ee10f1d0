"""Texts are split without patterns, and lowered once for all patterns, with the same parts as before."""

import random
import re

import pytest
from corvane.functions.dialect import JAVA_SPACE, SPACES, SparkSql
from corvane.functions.registry import shared_columns
from corvane.functions.task_metrics import MODULES, RULES
from pyspark.sql import functions as F

PIECES = ["a", "is", "Éa_1", "library", "which", "x", ".", "!", "?", "...", ". ", " ", "  ", "\t", "\t ", "\n", "\n \n", "'", '"', "中", "\U0001d400", "İ", " a", "—", "​", *SPACES]


def sql_of(module):
    d = SparkSql()
    return [*(sql for stage in shared_columns(d, module) for sql in stage.values()), *(RULES[module, m][0](d) for m in MODULES[module])]


def split_by_pattern(module):
    """Calls of split with a pattern that Java compiles for each text."""
    return [sql for sql in sql_of(module) if re.search(r'"\(\?d\)(?:[^"\\]|\\.)*", -1\)', sql)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    fixed = ["", " ", "\n", ".", "?!", "a", " a ", "a.b!c?d", "a  b", "library", "the library.", "libraryx", "'library'", "a\tb"]
    rows = [(t, rng.choice(["a", "is", "library", "", "which", "'", None])) for t in [*made, *fixed]] + [(None, "a")]
    return spark.createDataFrame(rows, "s string, w string").repartition(4).cache()


def differing(df, got, wanted):
    return df.where(f"({got}) IS DISTINCT FROM ({wanted})").select("s", "w", F.expr(got), F.expr(wanted)).take(3)


def test_parts_are_those_of_the_patterns(texts):
    d = SparkSql()
    spaces = d.lit(f"(?d){JAVA_SPACE}+")
    assert differing(texts, d.words("s"), f"filter(split(s, {spaces}, -1), x -> x <> '')") == []
    assert differing(texts, d.words("lower(s)"), f"filter(split(lower(s), {spaces}, -1), x -> x <> '')") == []
    for longer in (0, 10, 15):
        assert differing(texts, d.sentences("s", longer), f"filter(transform(split(s, '[.!?]+', -1), x -> {d.strip('x')}), x -> length(x) > {longer})") == []
    assert differing(texts, d.lines("s"), d.split("s", r"\n")) == []
    assert differing(texts, d.squeezed("s"), d.replace("s", r"[ \t]+", " ")) == []
    assert differing(texts, d.sort(d.words("s")), f"array_sort({d.words('s')})") == []


def test_words_of_a_text(texts):
    """Looked up one by one, and by the list of all words."""
    d = SparkSql()
    for asked in ("array('library', 'which')", d.every("concat(s, ' library')", r"\w{4,}"), "array()", "CAST(NULL AS array<string>)"):
        assert differing(texts, f"coalesce({d.says_one('s', asked)}, FALSE)", f"coalesce({d.size(d.common(d.every('s', r'\w{4,}'), asked))} > 0, FALSE)") == []
    quoted = f"{d.has_word('s', 'w')} OR contains(s, concat('\"', w, '\"')) OR contains(s, concat(\"'\", w, \"'\"))"
    assert differing(texts, f"coalesce({d.if_held('s', 'w', quoted)}, FALSE)", f"coalesce({quoted}, FALSE)") == []


def test_a_letter_of_two_code_units_is_no_border(spark):
    d = SparkSql()
    df = spark.createDataFrame([("\U0001d400library",), ("library\U0001d400",), ("\U0001f600library",)], "s string")
    got = df.select("s", F.expr(d.has_word("s", "'library'")), F.expr(d.matches("s", r"\blibrary\b"))).collect()
    assert {r[0]: r[1:] for r in got} == {"\U0001d400library": (False, False), "library\U0001d400": (False, False), "\U0001f600library": (True, True)}


def test_positive_splits_plainly_and_lowers_a_sentence_once():
    """F8: each of ten patterns lowered each sentence again, and a pattern was compiled for each split."""
    assert split_by_pattern("ecqa_positive") == []
    rule = RULES["ecqa_positive", "simple_atomic_sentences"][0](SparkSql())
    assert len(re.findall(r"\blower\(", rule)) == 1


def test_freeflow_splits_plainly_and_squeezes_only_double_blanks():
    """every blank of a text was replaced by itself."""
    assert split_by_pattern("ecqa_freeflow") == []
    even = next(sql for sql in sql_of("ecqa_freeflow") if "regexp_replace(r," in sql)
    assert even.startswith("CASE WHEN contains(r, '  ')")


def test_justification_splits_plainly_and_takes_no_list_of_all_words():
    """all words of a text were taken out for the few that the question holds."""
    assert split_by_pattern("cose_justification") == []
    assert not any("regexp_extract_all(rl," in sql for sql in sql_of("cose_justification"))
