"""Words of one pattern, which a linear hash would confuse, and names that share a half."""

import numpy as np
import public_tokenizers
import pytest
from corvane.llm import cas_store, decontam, jaccard, kernels, packing, quality, queries, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (512, 1024, 2048, 4096, 8192)]


def test_hashes_of_patterned_words_differ():
    words = [w for pair in TWINS for w in pair] + ["a" * n for n in range(1, 300)] + ["ab" * n for n in range(1, 300)]
    words = sorted({*words, *(w[::-1] for w in words)})
    hashes, at = kernels.words_of([" ".join(words).encode()], kernels.SPACED_WORD)
    assert len(hashes) == len(words) == len(np.unique(hashes)) == at[-1]
    twins = np.concatenate([kernels.shingle_hashes(kernels.words_of([f"{w} {v} {w}".encode()], kernels.SPACED_WORD)[0], 3) for pair in TWINS for w, v in (pair, pair[::-1])])
    assert len(np.unique(twins)) == 2 * len(TWINS)


@pytest.fixture(scope="module")
def twins(spark):
    rows = [(i, t) for i, pair in enumerate(TWINS) for t in pair]
    return spark.createDataFrame([(2 * i + k % 2, t) for k, (i, t) in enumerate(rows)], "doc_id long, text string").repartition(1)


def test_ids_are_the_librarys(twins):
    library = Tokenizer.from_file(TOKENIZER)
    encoder = tokens.Encoder(TOKENIZER)
    for pair in TWINS:
        ids, at = encoder.encode([t.encode() for t in pair])
        for i, t in enumerate(pair):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in twins.collect()}
    store = cas_store.write(twins, TOKENIZER, end_id=2)
    assert {r.doc_id: r.n_tokens for r in cas_store.read_digests(store).collect()} == want
    packed = packing.pack(twins, TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == want


def test_a_shared_hash_goes_to_the_library(monkeypatch):
    real = kernels.span_hashes
    monkeypatch.setattr(kernels, "span_hashes", lambda buf, s, e, seed=0: real(buf, s, e, seed) if seed else (e - s).astype(np.uint64))
    encoder = tokens.Encoder(TOKENIZER)
    for text in ("one international word and supranational ones", "extraordinary red two", "relationships"):
        assert encoder.encode([text.encode()])[0].tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_twins_are_no_near_duplicates(twins):
    assert {r.doc_id: r.component_id for r in jaccard.classes(twins).collect()} == {i: i for i in range(2 * len(TWINS))}
    assert jaccard.representatives(twins).count() == 2 * len(TWINS)


def test_twins_are_no_benchmark_passages(spark, twins):
    items = spark.createDataFrame([(i, pair[1]) for i, pair in enumerate(TWINS)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.find(twins, items).collect()}
    assert got == {2 * i + k: [str(i)] if k else [] for i in range(len(TWINS)) for k in range(2)}


def test_sets_that_share_half_a_name(spark, documents, monkeypatch):
    named = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 21), (None, None)], "node long, twin long")
    assert jaccard.shared_halves(named) == frozenset({2})
    monkeypatch.setattr(jaccard, "SHARED", 0)
    with pytest.raises(ValueError):
        jaccard.shared_halves(named)
    # As if every tenth set shared its half: those go by the other half, and nothing else changes.
    want = sorted(tuple(r) for r in jaccard.classes(documents).collect())
    monkeypatch.setattr(jaccard, "shared_halves", lambda named: frozenset(r.node for r in named.where("node % 10 = 0").select("node").distinct().collect()))
    assert sorted(tuple(r) for r in jaccard.classes(documents).collect()) == want


def test_a_repeated_id_does_not_widen_the_sample(spark, monkeypatch):
    seen = []
    real = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda row, cell, grade, n: (seen.append(len(grade)), real(row, cell, grade, n))[1])
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    quality.fit(docs, spark.createDataFrame([(1, 2)], "doc_id long, grade int"), 3, sample=10)
    assert seen == [10]
