"""The task queries over responses of every language, against brute force."""

import re

import pytest
from corvane.functions.task_metrics import MODULES
from corvane.plans import queries
from corvane.plans.cases import CASES

BENCH = "un deux été vélo cinq né sept huit"
TEXTS = [
    (0, "vélos été né", "fr"),
    (1, "Ein VÉLO (né) im Sommer", "de"),
    (2, "étés vélo, né", None),
    (3, "renés été", "es"),
    (4, "an été vélo né", "en"),
    (5, "x" * 600 + " renés and né", "fr"),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('small')}"
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_choices_of_every_language(spark, small):
    asked = BENCH.split()
    want = {}
    for i, text, _ in TEXTS:
        offered = [asked[2], asked[5], text.split()[1], asked[3]]
        want[i] = sum(bool(re.search(rf"\b{re.escape(c.lower())}\b", text.lower())) for c in offered) / 4
    rows = queries.QUERIES["task_ecqa_freeflow"](spark, small).where("doc_id >= 0").collect()
    assert {r.doc_id: r.all_choices_addressed for r in rows} == want
    assert 0 < min(want.values()) < max(want.values())


@pytest.mark.parametrize("name", [f"task_{m}" for m in MODULES] + ["task_registered_function"])
def test_every_response_is_scored(spark, small, name):
    ids = sorted(r.doc_id for r in queries.QUERIES[name](spark, small).collect())
    assert ids == [*range(-len(CASES), 0), *range(len(TEXTS))]
