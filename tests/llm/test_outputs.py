"""Media files, the token store, packing and the pipeline: round trips, brute force and odd inputs."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from corvane.llm import cas_store, decontam, jaccard, kernels, matroska, packing, queries, tokens
from corvane.llm.common import Lazy, blocks
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
library = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- tokens ------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="a b's't''re!?'ll'LLÀß÷×éİΣ0123\n\t<|endoftext|>\x1c ǅ", max_size=30)), max_size=5))
def test_encoder_is_the_library(texts):
    ids, at = Lazy(tokens.Encoder, TOKENIZER).get().encode([t.encode("utf-8", "replace") for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(t.encode("utf-8", "replace").decode())


def test_encoder_starts_its_table_anew(monkeypatch, documents):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    encoder = tokens.Encoder(TOKENIZER)
    assert encoder.fast
    for r in documents.limit(20).collect():
        assert encoder.encode([r.text.encode()])[0].tolist() == ids_of(r.text)


def test_other_tokenizers_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    assert not encoder.fast
    assert encoder.encode([b"Hello there", b""])[0].tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


@given(st.binary(max_size=50), st.binary(max_size=3000))
def test_crc_of_joined(a, b):
    assert kernels.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_blocks():
    assert list(blocks([5, 5, 5], 10)) == [slice(0, 1), slice(1, 2), slice(2, 3)]
    assert list(blocks([1, 1, 50, 1], 10)) == [slice(0, 2), slice(2, 3), slice(3, 4)]
    assert list(blocks([0] * 5, 10, 2)) == [slice(0, 2), slice(2, 4), slice(4, 5)] and list(blocks([])) == []


# ---- Matroska ------------------------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=5000))
def test_media_round_trip(text):
    payload = matroska.padded(text)
    assert len(payload) % 192 == 0 and len(payload) > 0 and payload.startswith(text) and not payload[len(text) :].strip(b" ")
    data = matroska.mux(payload)
    assert matroska.demux(data) == payload
    got = matroska.parse(data)
    assert [p.timestamp for p in got.packets] == [4 * i for i in range(len(payload) // 192)]
    assert got.tracks == {1: "A_PCM/INT/LIT"} and len(got.cues) == len(got.clusters)
    assert b"".join(data[p.start : p.end] for p in got.packets) == payload


def test_media_of_many_clusters():
    payload = bytes(range(256)) * 192 * 5
    got = matroska.parse(matroska.mux(payload))
    assert len(got.clusters) == 5 and matroska.demux(matroska.mux(payload)) == payload
    assert [c[0] for c in got.cues] == [i * 256 * 4 for i in range(5)]


def test_other_lacings_and_groups():
    m = matroska
    frames = [b"x" * 300, b"y" * 10, b"z" * 600]
    xiph = m.vint(2) + struct.pack(">h", 5) + b"\x02" + bytes([2]) + bytes([255, 45]) + bytes([10]) + b"".join(frames)
    sizes = m.vint(300) + (m.vint(10 - 300 + (1 << 13) - 1, 2))
    ebml = m.vint(2) + struct.pack(">h", 7) + b"\x86" + bytes([2]) + sizes + b"".join(frames)
    one = m.vint(300, 2) + struct.pack(">h", -1) + b"\x80" + b"q"
    cluster = m.number(m.CLUSTER_TIMESTAMP, 100) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, xiph) + m.number(m.REFERENCE, 1)) + m.element(m.SIMPLE_BLOCK, ebml) + m.element(m.SIMPLE_BLOCK, one)
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    data = m._HEADER + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + m.element(m.CUES, b"")
    got = m.parse(data).packets
    assert [(p.track, p.timestamp, p.lacing, p.key, p.end - p.start) for p in got] == [(2, 105, "xiph", False, 300), (2, 109, "xiph", False, 10), (2, 113, "xiph", False, 600), (2, 107, "ebml", True, 300), (2, 111, "ebml", True, 10), (2, 115, "ebml", True, 600), (300, 99, "none", True, 1)]
    with pytest.raises(ValueError):
        m.parse(m.mux(b" " * 192)[:-5])


def test_media_digest(odd_docs, no_docs):
    media = matroska.write(odd_docs)
    rows = sorted(matroska.digest(media).collect(), key=repr)
    assert len(rows) == odd_docs.count()
    want = []
    for r in odd_docs.collect():
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192) if text else b" " * 192
        want.append((r.doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    seven = {tuple(r)[1:] for r in rows if r.doc_id in (7, 8)}
    assert len(seven) == 1
    table = matroska.packets(media)
    assert table.where("doc_id = 1").select("byte_end", "byte_start", "lacing").first().lacing == "none"
    assert matroska.digest(matroska.write(no_docs)).count() == 0


# ---- token store ------------------------------------------------------------------------------------------------------------


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49_000, 30_000).astype(np.uint32)
    ends = cas_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= cas_store.MOST and sizes[:-1].min() >= cas_store.LEAST
    shifted = cas_store.cuts(np.concatenate([rng.integers(0, 49_000, 77).astype(np.uint32), ids]))
    assert len({e - 77 for e in shifted} & set(ends)) > 0.8 * len(ends)
    assert cas_store.cuts(ids[:1]) == [1]


def plain_stream(rows, end_id):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*ids_of(text), end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store(spark, documents):
    store = cas_store.write(documents, TOKENIZER, 2)
    got = cas_store.read_digests(store).orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == plain_stream(rows, 2)
    assert all(r.verified for r in got)
    chunks = store.chunks()
    assert chunks.count() == chunks.select("key").distinct().count()
    assert chunks.count() < store.recipes().select(F.explode("chunks")).count()  # copies share chunks
    back = {r.doc_id: r.ids for r in cas_store.read_ids(store, spark.createDataFrame([(3,), (17,)], "doc_id long")).collect()}
    texts = dict(rows)
    assert back == {i: [*ids_of(texts[i]), 2] for i in (3, 17)}


def test_store_notices_damage(spark, documents):
    store = cas_store.write(documents.limit(20), TOKENIZER, 2)
    good = store.chunks().collect()
    path = store.path + "-damaged"
    objects = spark.read.schema(cas_store.OBJECTS).parquet(f"{store.path}/objects")
    damaged = objects.withColumn("payload", F.when(F.col("key") == F.lit(bytes(good[0].key)), F.concat(F.col("payload"), F.lit(b"\0\0"))).otherwise(F.col("payload")))
    damaged.write.partitionBy("kind").parquet(f"{path}/objects")
    spark.read.parquet(f"{store.path}/stream").write.parquet(f"{path}/stream")
    assert not all(r.verified for r in cas_store.read_digests(cas_store.Store(spark, path)).collect())


def test_store_of_odd_inputs(odd_docs, no_docs):
    got = cas_store.read_digests(cas_store.write(odd_docs, TOKENIZER, 2)).orderBy("start").collect()
    want = plain_stream([(r.doc_id, r.text) for r in odd_docs.collect()], 2)
    assert len(got) == len(want) and got[-1].start + got[-1].n_tokens == want[-1][1] + want[-1][2]
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(repr((w[0], w[2], w[3])) for w in want)
    starts = {r.doc_id: r.start for r in got if r.doc_id in (1, 6, 8, 9)}
    assert starts == {w[0]: w[1] for w in want if w[0] in (1, 6, 8, 9)}
    assert cas_store.read_digests(cas_store.write(no_docs, TOKENIZER, 2)).count() == 0


# ---- packing --------------------------------------------------------------------------------------------------------------


def check_packed(rows, texts, capacity, end_id):
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = np.array([*ids_of(text), end_id], "<u4")
        want[doc_id] += [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places), sum(r.length for r in rows)


def test_packing(documents):
    rows = packing.pack(documents, TOKENIZER).collect()
    n, total = check_packed(rows, [(r.doc_id, r.text) for r in documents.collect()], 2048, 0)
    assert n <= 1.01 * -(-total // 2048) + 1


def test_packing_of_odd_inputs(odd_docs, no_docs):
    check_packed(packing.pack(odd_docs, TOKENIZER, capacity=64, shard=50).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 64, 0)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_local_search_keeps_items_and_helps(lengths):
    bins = packing.best_fit(lengths, 100)
    better = packing.improve(lengths, [list(b) for b in bins], 100)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in better) and len(better) <= len(bins)
    squares = lambda x: sum(sum(lengths[i] for i in b) ** 2 for b in x)
    assert squares(better) >= squares(bins)


def test_local_search_finds_exchanges():
    # Best fit needs three bins here; one swap empties the third.
    lengths = [55, 45, 41, 30, 29]
    bins = packing.best_fit(lengths, 100)
    assert len(packing.improve(lengths, bins, 100)) == 2
    rng = random.Random(0)
    many = [rng.randint(200, 700) for _ in range(400)]
    first = packing.best_fit(many, 1000)
    assert len(packing.improve(many, [list(b) for b in first], 1000)) <= len(first)


# ---- pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != "packing":
            assert made.columns == documents.columns
        rows = made.collect()
        seen[name] = rows
        docs = spark.createDataFrame(rows, made.schema)
    ids = {n: sorted(r.doc_id for r in rows) for n, rows in seen.items()}
    assert len(ids["language_id"]) >= 0.98 * documents.count()
    after_language = documents.where(F.col("doc_id").isin(ids["language_id"]))
    classes = jaccard.classes(after_language).collect()
    assert ids["near_duplicates"] == sorted({r.component_id for r in classes})
    hits = decontam.digest(decontam.find(after_language.where(F.col("doc_id").isin(ids["near_duplicates"])), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).collect()
    assert ids["decontamination"] == sorted(r.doc_id for r in hits if not r.contaminated)
    assert ids["secret_scan"] == ids["decontamination"]
    check_packed(seen["packing"], [(r.doc_id, r.text) for r in seen["secret_scan"]], 2048, 0)


def test_pipeline_of_odd_inputs(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
