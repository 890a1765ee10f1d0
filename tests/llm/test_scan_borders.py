"""Passages of the benchmark beside the border of two documents of a block."""

import random
import time

from corvane.llm import decontam, kernels


def test_passage_after_a_document_that_ends_within_the_item():
    words = [f"w{i}" for i in range(60)]
    index = decontam.Index([("0", " ".join(words).encode())])
    # Document 0 ends with the item's words up to i, document 1 begins with the next ten: each word stands on the same diagonal.
    missed = []
    for i in range(10, 45):
        texts = [" ".join(words[: i + 1]), " ".join(words[i + 1 : i + 11])]
        found = index.hits(*kernels.words_of([t.encode() for t in texts], kernels.ALNUM_WORD))
        missed += [i] * (found[1] != ([(0, 10)], {0}))
    assert not missed


def plain_hits(texts, items, window=10):
    """Marked words and items of each text, window by window."""
    out = []
    for t in texts:
        words, marked, names = t.split(), set(), set()
        for i, item in enumerate(items):
            own = item.split()
            m = min(window, len(own))
            grams = {tuple(own[j : j + m]) for j in range(len(own) - m + 1)} if own else set()
            for p in range(len(words) - m + 1 if own else 0):
                if tuple(words[p : p + m]) in grams:
                    marked.update(range(p, p + m))
                    names.add(i)
        out.append((marked, names))
    return out


def test_hits_of_repetitive_texts():
    rng = random.Random(9)
    for _ in range(60):
        vocabulary = ["a", "b", "c"][: rng.randint(1, 3)]
        line = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most)))
        items = [line(30) for _ in range(rng.randint(1, 4))]
        texts = [line(60) + " " + rng.choice(items) + " " + line(5) for _ in range(4)]
        index = decontam.Index([(str(i), x.encode()) for i, x in enumerate(items)])
        got = index.hits(*kernels.words_of([t.encode() for t in texts], kernels.ALNUM_WORD))
        assert [({w for s, e in spans for w in range(s, e)}, names) for spans, names in got] == plain_hits(texts, items)


def test_many_items_with_one_opening():
    opening = " ".join("common%d" % i for i in range(14))
    index = decontam.Index([(str(i), f"{opening} own{i} tail{i}".encode()) for i in range(20_000)])
    text = " ".join([*("w%d" % i for i in range(900)), opening, "own77 tail77", *("v%d" % i for i in range(1000)), opening])
    begin = time.perf_counter()
    ((spans, items),) = index.hits(*kernels.words_of([text.encode()], kernels.ALNUM_WORD))
    assert time.perf_counter() - begin < 2 and len(items) == 20_000 and spans == [(900, 916), (1916, 1930)]


def test_one_word_over_and_over():
    index = decontam.Index([("i", b"a " * 1000)])
    begin = time.perf_counter()
    ((spans, items),) = index.hits(*kernels.words_of([b"a " * 10_000], kernels.ALNUM_WORD))
    assert time.perf_counter() - begin < 20 and spans == [(0, 10_000)] and items == {0}


def test_blocks_of_the_benchmark(spark, documents, sf_dir):
    """Ten blocks, one held at a time, find and keep what one block does."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.selectExpr("sum(octet_length(text) div 2 + 1) AS n").first().n
    few = dict(block_words=words // 10)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(decontam.digest(decontam.find(documents, items, **few))) == rows(decontam.digest(decontam.find(documents, items)))
    assert rows(decontam.clean(documents, items, **few)) == rows(decontam.clean(documents, items))
