"""Timestamps of Matroska files with another clock and frame duration."""

import struct

from corvane.llm import matroska as m


def test_timestamp_scale_and_default_duration():
    track = m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.number(m.DEFAULT_DURATION, 20_000_000) + m.element(m.CODEC_ID, b"A_X"))
    laced = m.vint(1) + struct.pack(">h", 10) + b"\x84" + bytes([2]) + b"abc"
    cluster = m.element(m.CLUSTER, m.number(m.CLUSTER_TIMESTAMP, 100) + m.element(m.SIMPLE_BLOCK, laced))
    info = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 500_000))
    data = m._HEADER + m.element(m.SEGMENT, info + m.element(m.TRACKS, track) + cluster)
    assert [p.timestamp for p in m.parse(data).packets] == [55, 75, 95]
