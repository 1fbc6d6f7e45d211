"""Round trips of Matroska files, and hand-made ones."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 255))
def test_round_trip(units, fill):
    payload = bytes((fill + k) % 256 for k in range(units * m.UNIT))
    data = m.encode_media(payload)
    media = m.parse(data)
    assert b"".join(data[p.start : p.start + p.size] for p in media.packets) == payload
    assert [at for _, _, at in media.cues] == media.clusters and media.tracks == [1]
    times = [p.timestamp_ms for p in media.packets]
    assert times == sorted(times)


@given(st.integers(0, 2**40))
def test_integers(n):
    raw = m.vint(n)
    assert m.read_vint(raw, 0) == (n, len(raw), len(raw))


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_lacings(lacing):
    sizes = {m.NO_LACING: [700], m.FIXED: [300, 300, 300]}.get(lacing, [255, 700, 1, 510, 3])
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    body = m.block(lacing, frames, -5)
    cluster = m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 40), m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body)))
    info = m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 2_000_000))
    data = m.HEAD + m.element(m.SEGMENT, info, m.element(0xEC, b"void"), cluster)
    media = m.parse(data)
    assert [data[p.start : p.start + p.size] for p in media.packets] == frames and {p.timestamp_ms for p in media.packets} == {70}


def test_unknown_sizes():
    body = m.element(m.SIMPLE_BLOCK, m.block(m.NO_LACING, [b"abc"], 0))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.uint(m.TIMESTAMP, 1) + body
    data = m.HEAD + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    assert [(p.cluster_no, data[p.start : p.start + p.size]) for p in m.parse(data).packets] == [(0, b"abc"), (1, b"abc")]


@pytest.mark.parametrize("data", [b"", b"RIFF", m.HEAD[:-3], m.HEAD + m.element(m.SEGMENT, m.CLUSTER.to_bytes(4, "big") + b"\x9f")])
def test_broken_files(data):
    with pytest.raises(ValueError):
        m.parse(data)


def test_frames(spark):
    texts = [None, "", "x", "é" * 96, "y" * 192, "z" * 300_000]
    docs = spark.createDataFrame([(k if k else None, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    table = m.media_table(docs)
    for r in m.read_media(table).collect():
        raw = (texts[r.doc_id or 0] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = {(r.media_sha256, r.feature) for r in m.read_media(table).where("n_bytes = 0").collect()}
    assert len(same) == 1
    assert m.packets(table).where("doc_id = 5").selectExpr("sum(size) as n").first().n == 300_096
    assert m.read_media(m.media_table(docs.limit(0))).count() == 0 == m.packets(m.media_table(docs.limit(0))).count()


def test_cues_of_several_tracks_and_references():
    positions = [m.element(m.CUE_POSITIONS, m.uint(m.CUE_TRACK, t), m.uint(m.CUE_CLUSTER, 7 * t)) for t in (1, 2, 3)]
    body = m.block(m.NO_LACING, [b"abc"], 0)
    groups = [m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body)), m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body), m.element(m.REFERENCE, b"\xff"))]
    data = m.HEAD + m.element(m.SEGMENT, m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 0), *groups), m.element(m.CUES, m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 5), *positions)))
    media = m.parse(data)
    assert [p.keyframe for p in media.packets] == [True, False]
    start = media.clusters[0]
    assert media.cues == [(5, t, start + 7 * t) for t in (1, 2, 3)]


@pytest.mark.parametrize("kind", [m.TAGS, m.CHAPTERS, m.ATTACHMENTS, m.SEEK_HEAD, m.CUES])
def test_an_open_cluster_ends_before_what_it_cannot_hold(kind):
    body = m.element(m.SIMPLE_BLOCK, m.block(m.NO_LACING, [b"abc"], 0))
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.uint(m.TIMESTAMP, 1) + body
    data = m.HEAD + m.element(m.SEGMENT, cluster, m.element(kind, *([] if kind == m.CUES else [m.element(m.SIMPLE_BLOCK, b"no block")])), cluster)
    assert [p.cluster_no for p in m.parse(data).packets] == [0, 1]


def test_broken_rows_do_not_end_the_job(spark):
    lacking = m.HEAD + m.element(m.SEGMENT, m.element(m.CUES, m.element(m.CUE_POINT, m.uint(m.CUE_TIME, 5))))
    cut = m.HEAD + m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.SIMPLE_BLOCK, b"\x81\x00")))
    rows = [(1, m.encode_media(b"x" * 192)), (2, b"RIFF"), (3, lacking), (4, None), (5, cut)]
    for data in (lacking, cut):
        with pytest.raises(ValueError):
            m.parse(data)
    got = m.packets(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((r.doc_id, r.error is None) for r in got) == [(1, True), (2, False), (3, False), (5, False)]
