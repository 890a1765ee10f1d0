import random

import pytest

from corvane.llm import matroska, secret_scan


def test_damaged_files_raise_value_errors_only():
    rng = random.Random(9)
    whole = matroska.mux(bytes(range(192)) * 40)
    raised = 0
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data)) if rng.random() < 0.3 else rng.randrange(200)] = rng.randrange(256)
        if rng.random() < 0.3:
            data = data[: rng.randrange(len(data))]
        try:
            matroska.parse(bytes(data))
        except ValueError:
            raised += 1
    assert raised > 100


def test_an_unknown_size_cluster_ends_at_tags():
    m = matroska
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.number(m.CLUSTER_TIMESTAMP, 5) + m._block(1, 0, [b"abc"], False)
    tags = m.element(m.TAGS, m.element(m.VOID, b"\x00\x00"))
    got = m.parse(m._HEADER + m.element(m.SEGMENT, m._TRACKS + cluster + tags))
    assert [(p.timestamp, p.end - p.start) for p in got.packets] == [(5, 3)]


@pytest.mark.parametrize("kind", ["string", "long", "int", "double"])
def test_redact_with_n_chars_of_any_type(spark, kind):
    docs = spark.sql(f"select * from values (1L, 'password = hunter2222', cast('21' as {kind})), (2L, null, null) as t(doc_id, text, n_chars)")
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert "hunter" not in rows[1].text and rows[2].text is None
    assert rows[1].n_chars == ("21" if kind == "string" else len(rows[1].text))
