"""Language, licences, secrets and quality against plain versions, held-out accuracy and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from corvane.llm import langid, licenses, quality, queries, secret_scan
from pyspark.sql import functions as F


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- language ----------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir, documents):
    out = queries.op1_language_id(spark, sf_dir).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == documents.count()
    held = [r for r in out if r.held_out]
    assert 0.15 < len(held) / len(out) < 0.35
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert not [r for r in out if r.rejected and any(c.isalpha() for c in r.text)]
    assert all(0 <= r.score <= 1 for r in out)


def test_language_ignores_labels_of_the_held_out_fold(spark, documents):
    wrong = documents.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    model = queries.learned_languages(wrong)
    assert "xx" not in model.languages


def test_language_rejects_what_is_far(documents):
    model = queries.learned_languages(documents)
    lang, score, rejected = model.predict(["これは日本語の文章です。" * 20, "zzz qqq xxx kkk vvv " * 20, "and the of that with"] and ["これは日本語の文章です。".encode() * 20, b"zzzqqq xxkqzv kkvvxq " * 30, b"of the and that with from this"])
    assert rejected.tolist() == [True, True, False] and lang[2] == "en"


def test_language_odd_inputs(odd_docs, no_docs, documents):
    model = queries.learned_languages(documents)
    out = langid.classify(odd_docs, model).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        if r.doc_id in (2, 3, 4, 5):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages
    assert langid.classify(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {(r.lang_pred, r.rejected) for r in langid.classify(odd_docs, nothing).collect()} == {("und", True)}
    kept = langid.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in odd_docs.collect()]
    far = model.predict([t.encode() for t in texts])[2]
    assert sorted(r.text for r in kept.collect()) == sorted(t for t, f in zip(texts, far) if not f)


# ---- licences -------------------------------------------------------------------------------------------------------


def plain_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_license_base(documents, odd_docs):
    rng = random.Random(5)
    pieces = ["mit", "license", "apache", "general", "public", "license,", "GNU", "the", "é", "MIT-License", "version", "7"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    spark = documents.sparkSession
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).union(odd_docs.where("doc_id IS NOT NULL").select(F.col("doc_id") + 100_000, "text"))
    source = {r.doc_id: r.text for r in df.collect()}
    for r in licenses.scan(df).collect():
        n, places = plain_licenses(source[r.doc_id])
        starts = [s for s, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_matching_statistics():
    rng = random.Random(2)
    templates = {"a": ["x y z x y w", "w w x"], "b": ["y z x y"]}
    automaton = licenses.Automaton(templates, {"z x": "p"})
    sources = [t.split() for own in templates.values() for t in own] + [["z", "x"]]
    parts = {tuple(s[i:j]) for s in sources for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        text = [rng.choice("xyzw") for _ in range(30)]
        got = automaton.statistics([automaton.number[w.encode()] for w in text])
        for i, (_, held) in enumerate(got):
            assert held == max([k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in parts], default=0)


def test_license_templates():
    scan = licenses.Scanner().scan
    mit = licenses.TEMPLATES["mit"][0]
    spans = scan(("Intro words. " + mit.replace("merge", "merges", 1) + " Outro.").encode())["spans"]
    assert [s[0] for s in spans] == ["mit"] and spans[0][1] == 2 and spans[0][3] > 0.9
    assert scan(b"to use copy the software and of this")["spans"] == []
    assert {s[0] for s in scan(licenses.TEMPLATES["bsd"][0].encode())["spans"]} == {"bsd"}


def test_license_empty(no_docs):
    assert licenses.scan(no_docs).count() == 0


# ---- secrets ---------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secret_base(documents, odd_docs):
    rng = random.Random(1)
    pieces = ["password", "Passwd", " = ", ":", '"', "'", "api_key", "APIKEY", "tok", "token", "ſecret", "SECRET", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "xyz", " ", "\n", "é", "=", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    spark = documents.sparkSession
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).union(odd_docs.where("doc_id IS NOT NULL").select(F.col("doc_id") + 100_000, "text"))
    source = {r.doc_id: r.text or "" for r in df.collect()}
    for r in secret_scan.scan(df).collect():
        base = plain_secrets(source[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_secret_models_hold_on_new_samples():
    scanner = secret_scan.Scanner()
    score = scanner.model.score
    fresh = secret_scan.random_samples(400, seed=99)
    ordinary = [s for s in secret_scan.ordinary_samples(400, seed=98) if len(s) >= 20]
    assert np.mean([score(s) >= scanner.threshold for s in fresh]) > 0.95
    assert np.mean([score(s) >= scanner.threshold for s in ordinary]) < 0.02
    spans = scanner.spans("see sk1Zq8Vt0Lw3Xy7Bn5Mc2Kd9Pf4Rg6Hj in request_handler_factory_2024_version_value")[1]
    assert [(k, s) for k, s, _ in spans] == [("markov", 4)]


def test_secret_models_leave_the_corpus_alone(documents):
    spans = secret_scan.scan(documents).agg(F.count_if(F.col("spans").contains("markov"))).first()[0]
    assert spans <= 0.01 * documents.count()


def test_redaction(spark, odd_docs, no_docs):
    df = spark.createDataFrame([(1, "token: abcdefgh end", 19), (2, "nothing", 99), (3, None, None)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in secret_scan.redact(df).collect()] == [(1, "[secret] end", 12), (2, "nothing", 99), (3, None, None)]
    assert secret_scan.redact(odd_docs).columns == odd_docs.columns and secret_scan.redact(odd_docs).count() == odd_docs.count()
    assert secret_scan.redact(no_docs).count() == secret_scan.scan(no_docs).count() == 0


# ---- quality -----------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, documents, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    ratings = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, ratings.where(~held), 3)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(docs, model).join(ratings.where(held), "doc_id").collect()
    assert np.mean([r.selected == (r.grade == 2) for r in rows]) > 0.85
    mean = {g: np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 2)}
    assert mean[0] < mean[2]
    assert all(0 <= r.p_best <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_quality_gradient():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    rows, cells = [], []
    for i, g in enumerate(grade):
        for c in {int(g) + 1, int(rng.integers(10, 40))}:
            rows.append(i)
            cells.append(c)
    model = quality.fit_rows(np.array(rows), np.array(cells), grade, 3)
    assert model.weights[1] < model.weights[2] < model.weights[3]


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    ratings = spark.createDataFrame([(1, 2), (2, 0), (6, 1), (7, 2), (8, None), (None, 1), (99, 1)], "doc_id long, grade int")
    model = quality.fit(odd_docs, ratings, 3)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.p_best <= 1 for r in out)
    assert len({(r.expected_grade, r.p_best) for r in out if r.doc_id in (7, 8)}) == 1
    assert quality.score(no_docs, model).count() == 0
    empty = quality.fit(odd_docs, ratings.where("doc_id = -1"), 3)
    assert {(r.expected_grade, r.selected) for r in quality.score(odd_docs, empty).collect()} == {(0.0, False)}
    assert quality.features([]) is not None and pytest
