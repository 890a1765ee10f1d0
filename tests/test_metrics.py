"""Token, n-gram and task metrics on hand-computed cases."""

import math

import pytest
from corvane.functions import ngram
from corvane.functions.core_metrics import TOKEN_METRICS, cosine_similarity, token_scores
from corvane.functions.registry import MetricRegistry, module_scores
from corvane.functions.task_metrics import MODULES, SETUP_MODULES
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "id long, response string, expected_output string, question_values array<string>, success boolean"
QUESTION = "Where would a person store old printed books safely"
CHOICES = [QUESTION, "library", "kitchen", "river", "library"]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def scored(spark, module, metric, rows):
    out = module_scores(frame(spark, rows), module, ["id"]).orderBy("id").collect()
    return [round(r[metric], 6) for r in out]


def test_token_metrics(spark):
    rows = [("", "", None, True), ("a", "", None, True), ("  A b b ", "a\tB", None, True), ("a b c", "b c d e", None, True), (None, "x", None, True), ("x", "x", None, False), ("x", "x", None, None), ("É A", "é a", None, True)]
    got = [[round(r[m], 6) for m in TOKEN_METRICS] + [r.generation_failed] for r in token_scores(frame(spark, rows), ["id"]).orderBy("id").collect()]
    assert got[0] == [1, 1, 1, 1, 1, 0]
    assert got[1] == [0, 0, 0, 0, 0, 0]
    assert got[2] == [0, 1, 1, 1, 1, 0]
    assert got[3] == [0, round(2 / 3, 6), 0.5, round(4 / 7, 6), 0.4, 0]
    assert got[4][:5] == [0] * 5
    assert got[5] == [0, 0, 0, 0, 0, 1]
    assert got[6] == [0, 0, 0, 0, 0, 1]
    assert got[7] == [1, 1, 1, 1, 1, 0]


def test_clashing_column_names(spark):
    df = frame(spark, [("a", "a", None, True)]).withColumn("r", F.lit(1)).withColumn("ok", F.lit(False)).withColumn("qv", F.lit("x"))
    assert token_scores(df, ["id", "r"]).first().exact_match == 1.0


def test_empty_table(spark):
    assert token_scores(frame(spark, []), ["id"]).count() == 0
    for module in MODULES:
        assert module_scores(frame(spark, []), module, ["id"]).count() == 0


def test_every_setup_has_a_module():
    assert len(SETUP_MODULES) == 16
    assert set(SETUP_MODULES.values()) == set(MODULES)
    assert sum(map(len, MODULES.values())) == 37


@pytest.mark.parametrize("module", list(MODULES))
def test_failed_and_null_responses_score_nothing(spark, module):
    rows = [("library", "library", CHOICES, False), (None, "library", CHOICES, True), ("library", "library", CHOICES, None)]
    for r in module_scores(frame(spark, rows), module, ["id"]).collect():
        assert all(r[m] == 0.0 for m in MODULES[module])


def ladder(spark, module, metric, sizes, text="x"):
    return scored(spark, module, metric, [(text * n, "x", CHOICES, True) for n in sizes])


def test_length_ladders(spark):
    assert ladder(spark, "cose_choice", "response_conciseness", [0, 20, 21, 50, 51, 200, 201, 500, 501]) == [0, 1, 0.8, 0.8, 0.5, 0.5, 0.2, 0.2, 0]
    words = scored(spark, "ecare_explanation", "response_brevity", [(" ".join(["w"] * n), "x", None, True) for n in (0, 4, 5, 25, 26, 50, 51, 100, 101, 200, 201, 400, 401)])
    assert words == [0, 0, 1, 1, 0.8, 0.8, 0.5, 0.5, 0.3, 0.3, 0.1, 0.1, 0]
    reasons = scored(spark, "cose_explanation", "explanation_quality", [("because" + "x" * (n - 7), "x", None, True) for n in (49, 50, 300, 301, 500, 501, 800, 801, 1500, 1501)])
    assert reasons == [0, 1, 1, 0.8, 0.8, 0.6, 0.6, 0.3, 0.3, 0]
    short = scored(spark, "pubmedqa_free", "no_explanation_penalty", [(t, "x", None, True) for t in ("y" * 10, "y" * 11, "y" * 15, "y" * 16, "y" * 51, "y" * 101, "a b")])
    assert short == [1, 0.7, 0.7, 0.4, 0.2, 0, 0.4]


def test_choice_answers(spark):
    rows = [("LIBRARY ", "library", None, True), ("it is the library.", "library", None, True), ("answer: lib", "library", None, True), ("river", "library", None, True), ("", "library", None, True)]
    assert scored(spark, "cose_choice", "answer_correctness", rows) == [1, 1, 1, 0, 0]
    rows = [("fine", "x", None, True), ("Thank you! Question: a Question: b", "x", None, True), ("\n".join(["same"] * 21), "x", None, True), ("because of the reason", "x", None, True), ("A repeated part. " * 3 + "x. " * 8, "x", None, True)]
    assert scored(spark, "cose_choice", "instruction_following_penalty", rows) == [1, 0.5, 0.5, 0.8, 0.5]


def test_explained_answers(spark):
    values = ["q", "['library', 'kitchen']"]
    rows = [("The answer is library.", "a library", values, True), ("the answer is library", "nothing", values, True), ("kitchen", "the kitchen", values, True), ("river", "river", values, True), ("library", "library", ["q", "no list"], True), ("library", "library", ["q"], True), ("library", "library", ["q", '["library"]'], True)]
    assert scored(spark, "cose_explanation", "answer_identification_correctness", rows) == [1, 0.5, 1, 0, 0, 0, 1]


def test_justifications(spark):
    rows = [("no grounds", "x", ["q", "a"], True), ("so it is", "x", ["q", "a"], True), ("it is so as we all know today", "x", ["q", "a"], True), ("because books are stored", "x", ["where are books", "a"], True)]
    assert scored(spark, "cose_justification", "explanation_correctness", rows) == [0, 0.3, 0.7, 1]
    rows = [("x" * 49, "x", None, True), ("x" * 50, "x", None, True), ("x" * 200, "x", None, True), ("x" * 201, "x", None, True), ("x" * 401, "x", None, True), ("x" * 601, "x", None, True), ("x" * 1001, "x", None, True)]
    assert scored(spark, "cose_justification", "brevity_compliance", rows) == [0.8, 1, 1, 0.8, 0.5, 0.2, 0]
    rows = [("plain", "x", None, True), ("step 3: go", "x", None, True), ("the best answer is x. answer is: x", "x", None, True), ("what is it? and why?", "x", None, True)]
    assert scored(spark, "cose_justification", "format_cleanliness", rows) == [1, 0.8, 0.8, 0.7]


def test_hypotheses(spark):
    rows = [("0", "0", None, True), ("Hypothesis 1", "1", None, True), ("answer is: 0", "0", None, True), ("maybe 1, who knows", "1", None, True), ("10", "1", None, True), ("", "1", None, True)]
    assert scored(spark, "ecare_choice", "answer_correctness", rows) == [1, 1, 1, 1, 0, 0]
    rows = [("1", "1", None, True), ("Hypothesis 1", "1", None, True), ("Hypothesis 1 " + "x" * 20, "1", None, True), ("Hypothesis 1 " + "x" * 100, "1", None, True), ("none", "1", None, True)]
    assert scored(spark, "ecare_choice", "follows_format_instruction", rows) == [1, 0.8, 0.5, 0.2, 0]
    rows = [("1", "1", None, True), ("hypothesis 0 but hypothesis 1", "1", None, True), ("hypothesis 1 " + "x" * 20, "1", None, True), ("x" * 20 + " hypothesis 1", "1", None, True)]
    assert scored(spark, "ecare_choice", "answer_extractability", rows) == [1, 0.3, 1, 0.4]


def test_five_way_choice(spark):
    rows = [("My choice is 'Library'", "library", CHOICES[:-1], True), ("the answer is river because it flows.", "river", CHOICES[:-1], True), ("I take the kitchen", "kitchen", CHOICES[:-1], True), ("nothing", "kitchen", CHOICES[:-1], True), ("they wrote 'the attic'", "attic", CHOICES[:-1], True), ("library", "", CHOICES[:-1], True)]
    assert scored(spark, "ecqa_choice", "answer_correctness", rows) == [1, 1, 1, 0, 1, 1]
    rows = [("library", "x", CHOICES[:-1], True), ("library, kitchen and river", "x", CHOICES[:-1], True), ("the answer is library", "x", CHOICES[:-1], True)]
    assert scored(spark, "ecqa_choice", "answer_extractability", rows) == [1, 0.7, 0.6]
    with_topic = ["storage", QUESTION, "a+b", "river"]
    assert scored(spark, "ecqa_choice", "answer_correctness", [("river then", "river", with_topic, True)]) == [1]


def test_free_explanations(spark):
    rows = [("library and 'kitchen' but no stream", "x", CHOICES, True), ("Library, kitchen, river", "x", CHOICES, True), ("x", "x", ["q", "a"], True)]
    assert scored(spark, "ecqa_freeflow", "all_choices_addressed", rows) == [round(2 / 3, 6), 1, 0]
    rows = [("One line.", "x", None, True), ("One.\n\ntwo", "x", None, True), ("- a", "x", None, True), ("a\n1) b", "x", None, True), ("A\n\nB\n\nC", "x", None, True), ("A\nB\nC", "x", None, True)]
    assert scored(spark, "ecqa_freeflow", "single_paragraph_format", rows) == [1, 0.7, 0, 0, 0.2, 0.7]
    assert scored(spark, "ecqa_freeflow", "explanation_depth", [("because it typically leads to x", "x", ["none"], True), ("", "x", ["q"], True)]) == [0.28, 0]


def test_negative_and_positive(spark):
    rows = [("kitchen or river", "x", CHOICES, True), ("kitchen", "x", CHOICES, True), ("kitchen river library library library library", "x", CHOICES, True), ("x", "x", ["q", "a", "a"], True)]
    assert scored(spark, "ecqa_negative", "incorrect_choices_coverage", rows) == [1, 0.5, 0.8, 0]
    rows = [("Short one. And another but so.", "x", None, True), (" ".join(["w"] * 31), "x", None, True), ("...", "x", None, True)]
    assert scored(spark, "ecqa_negative", "atomic_sentence_format", rows) == [0.7, 0.4, 0]
    rows = [("a library", "x", CHOICES, True), ("a library unlike a river", "x", CHOICES, True), ("a shelf", "x", CHOICES, True), ("x", "x", ["q"], True)]
    assert scored(spark, "ecqa_positive", "correct_answer_focus", rows) == [1, 0.6, 0, 0]
    rows = [("One. Two.", "x", None, True), ("which is it", "x", None, True), (" ".join(["w"] * 26), "x", None, True)]
    assert scored(spark, "ecqa_positive", "simple_atomic_sentences", rows) == [1, 0.7, 0.7]
    rows = [("One.", "x", None, True), ("a. b. c. d.", "x", None, True), (" ".join(["w"] * 16), "x", None, True), ("", "x", None, True)]
    assert scored(spark, "ecqa_positive", "concise_justification", rows) == [1, 0.82, 0.96, 0]


def test_edit_explanations(spark):
    b = "- a\n"
    rows = [(b * n, b * 10, None, True) for n in (0, 5, 8, 10, 12, 15, 20)] + [("x", "y", None, True), ("- x", "y", None, True), ("• a\n* b", "- a\n- b", None, True)]
    assert scored(spark, "gmeg", "bullet_point_ratio", rows) == [0, 0.05, 0.6, 1, 0.6, 0.05, 0, 1, 0, 1]
    assert scored(spark, "gmeg", "structural_format_match", [("- a", "* b", None, True), ("a", "- b", None, True)]) == [1, 0]
    assert scored(spark, "gmeg", "correction_terminology_recall", [("spelling", "Spelling and tense", None, True), ("x", "x", None, True), ("fixed", "x", None, True)]) == [0.5, 1, 0.5]
    rows = [("home", "x", ["He went home.", "y"], True), ("home", "x", ["He went home."], True), ("x", "x", [" ", "y"], True)]
    assert scored(spark, "gmeg", "original_text_mention", rows) == [0.5, 0, 1]


def test_yes_no_maybe(spark):
    texts = ["yes", "Yes", "yes.", "Yes!", "YES", "it is yes", ""]
    assert scored(spark, "pubmedqa_free", "strict_format_compliance", [(t, "yes", None, True) for t in texts]) == [1, 0.8, 0.5, 0.4, 0.3, 0, 0]
    both = [("no maybe", "no", None, True), ("nothing known", "no", None, True), ("maybe", "maybe", None, True)]
    for module in ("pubmedqa_free", "pubmedqa_required"):
        assert scored(spark, module, "answer_correctness", both) == [1, 0, 1]
    rows = [("yes", "no", None, True), ("maybe", "maybe", None, True), ("maybe", "no", None, True), ("?", "odd", None, True)]
    assert scored(spark, "pubmedqa_required", "maybe_overuse_penalty", rows) == [1, 1, 0.3, 0.5]
    rows = [("yes", "yes", None, True), ("yes", "no", None, True), ("maybe", "maybe", None, True), ("maybe", "no", None, True), ("?", "no", None, True)]
    assert scored(spark, "pubmedqa_required", "confidence_calibration", rows) == [1, 0.5, 0.7, 0.5, 0]


def test_registered_functions(spark):
    registry = MetricRegistry()
    registry.register("size", lambda r: len(r["response"]))
    registry.register("broken", lambda r: 1 / 0)
    registry.register("text", lambda r: "no number")
    registry.register("flag", lambda r: True)
    with pytest.raises(ValueError):
        registry.register("none", 3)
    row = registry.scores(frame(spark, [("abc", "x", None, True), ("abc", "x", None, False)]), "gmeg", ["id"]).orderBy("id").collect()
    assert (row[0].size, row[0].broken, row[0].text, row[0].flag) == (3, 0, 0, 1)
    assert row[1].size == 0
    long = registry.long_scores(frame(spark, [("abc", "x", None, True)]).withColumn("setup", F.lit("gmeg")), "setup", ["setup", "id"])
    assert sorted(r.metric for r in long.collect()) == sorted([*MODULES["gmeg"], "size", "broken", "text", "flag"])
    twice = registry.scores(frame(spark, [("abc", "x", None, True), ("abcd", "x", None, True)]).withColumn("id", F.lit(None).cast("long")), "gmeg", ["id"])
    assert sorted(r["size"] for r in twice.collect()) == [3, 4]  # null and repeated keys keep their rows
    other = registry.long_scores(frame(spark, [("abc", "x", None, True)]).withColumn("setup", F.lit("none")), "setup", ["setup", "id"])
    assert sorted(r.metric for r in other.collect()) == ["broken", "flag", "size", "text"]


def test_bleu_by_hand():
    assert ngram.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1)
    # one word of five wrong: 4/5, 2/4, 1/3 and, smoothed, 1/(2*2)
    assert ngram.bleu("a b c x e", "a b c d e") == pytest.approx((4 / 5 * 2 / 4 * 1 / 3 * 1 / 4) ** 0.25)
    assert ngram.bleu("a b", "a b c d") == pytest.approx(math.exp(1 - 4 / 2))
    assert ngram.bleu("x", "y") == 0
    assert ngram.tokens_13a('He said: "it\'s 3.5%, ok"-') == ["He", "said", ":", '"', "it's", "3.5", "%", ",", "ok", '"', "-"]


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control", "rolling": "roll"}
    assert {w: ngram.Porter().stem(w) for w in known} == known


def test_rouge_by_hand():
    one, two, longest = ngram.rouge("the cat was found under the bed", "the cat was under the bed")
    assert one == pytest.approx(2 * 6 / 13) and two == pytest.approx(2 * 4 / 11) and longest == pytest.approx(2 * 6 / 13)
    assert ngram.rouge("été", "t") == pytest.approx((1.0, 0, 1.0))


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert ngram.common_subsequence(a, b) == table[-1][-1]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([-1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity("a", "b")).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0, 0, 0, -1])
