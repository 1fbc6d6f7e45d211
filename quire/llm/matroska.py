"""Media columns: Matroska files in a binary column, and their packet tables.

encode_media() stores a text's bytes as 8-bit PCM samples (8 kHz, one track): frames of 24 ms and its multiples,
in SimpleBlocks with no, Xiph, fixed-size and EBML lacing in turn, in clusters with cues. The stored form
depends on the text alone. packets() parses any Matroska bytes made of known elements: variable-length ids
and sizes (unknown sizes too), clusters, SimpleBlocks and BlockGroups, all four lacings, and cues; it gives a
row for each packet with its track, timestamp and byte range.

Defined cases: null text counts as empty (its payload is 192 spaces); null media has no packets; of bytes
that are no Matroska, or broken, parse() raises ValueError and packets() gives one row with the error; ids and repeated rows are kept as they stand; empty tables give
no rows; other columns are ignored. Each row is handled alone, so a very long text costs memory for
itself only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, text_bytes

UNIT = 192  # bytes of 24 ms
RATE = 8000
MS_PER_UNIT = UNIT * 1000 // RATE
BLOCKS_PER_CLUSTER = 16

# Fixed values of the format (element ids).
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP_SCALE, TRACK_NUMBER, REFERENCE = 0x2AD7B1, 0xD7, 0xFB
TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD = 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74
#: What can't be inside a cluster.
ABOVE_CLUSTERS = frozenset((EBML, SEGMENT, CLUSTER, CUES, INFO, TRACKS, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: What the blocks hold in turn: lacing and the units of each frame.
PATTERN = ((NO_LACING, (4,)), (XIPH, (1, 2, 1)), (FIXED, (2, 2, 2, 2)), (EBML_LACING, (3, 1, 4, 2)))
TRACK = 1


def vint(n: int, width: int = 0) -> bytes:
    """A size (or lace size) of 1 to 8 bytes; all ones are kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return vint(n + (1 << 7 * width - 1) - 1, width)


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, uint(0x4286, 1), uint(0x42F7, 1), uint(0x42F2, 4), uint(0x42F3, 8), element(0x4282, b"matroska"), uint(0x4287, 4), uint(0x4285, 2))
TRACK_HEAD = element(
    TRACKS,
    element(TRACK_ENTRY, uint(TRACK_NUMBER, TRACK), uint(0x73C5, TRACK), uint(0x83, 2), uint(0x9C, 1), element(0x86, b"A_PCM/INT/LIT"), element(AUDIO, element(0xB5, struct.pack(">d", RATE)), uint(0x9F, 1), uint(0x6264, 8))),
)


def block(lacing: int, frames: list[bytes], at_ms: int) -> bytes:
    """Body of a SimpleBlock; at_ms counts from the cluster's timestamp."""
    head = vint(TRACK) + struct.pack(">hB", at_ms, 0x80 | lacing << 1)
    sizes = [len(f) for f in frames]
    laces = bytes([len(frames) - 1]) if lacing else b""
    if lacing == XIPH:
        laces += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        laces += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + laces + b"".join(frames)


def encode_media(payload: bytes) -> bytes:
    """A Matroska file with the payload (a multiple of UNIT bytes) as samples."""
    blocks, at, k = [], 0, 0  # (time in ms, element)
    while at < len(payload):
        lacing, units = PATTERN[k % len(PATTERN)]
        frames, start = [], at
        for n in units:
            if at < len(payload):
                frames.append(payload[at : at + n * UNIT])
                at += len(frames[-1])
        if lacing == FIXED and len({len(f) for f in frames}) > 1:
            lacing = EBML_LACING  # the last frame is shorter
        blocks.append((start // UNIT * MS_PER_UNIT, NO_LACING if len(frames) == 1 else lacing, frames))
        k += 1
    duration = len(payload) // UNIT * MS_PER_UNIT
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000), element(0x4489, struct.pack(">d", duration)), element(0x4D80, b"quire"), element(0x5741, b"quire"))
    body, cues = [info, TRACK_HEAD], []
    for i in range(0, len(blocks), BLOCKS_PER_CLUSTER):
        group = blocks[i : i + BLOCKS_PER_CLUSTER]
        cues.append(element(CUE_POINT, uint(CUE_TIME, group[0][0]), element(CUE_POSITIONS, uint(CUE_TRACK, TRACK), uint(CUE_CLUSTER, sum(map(len, body))))))
        body.append(element(CLUSTER, uint(TIMESTAMP, group[0][0]), *(element(SIMPLE_BLOCK, block(lacing, frames, t - group[0][0])) for t, lacing, frames in group)))
    return HEAD + element(SEGMENT, *body, element(CUES, *cues))


class Packet(NamedTuple):
    packet_no: int
    track: int
    timestamp_ms: int
    start: int
    size: int
    cluster_no: int
    lacing: int
    keyframe: bool


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, byte at which the cluster starts
    clusters: list[int]  # bytes at which clusters start
    tracks: list[int]


def read_vint(data: bytes, at: int, mask: bool = True) -> tuple[int, int, int]:
    """(value, width, next byte); mask: without the length marker."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the data end inside an integer")
    value = int.from_bytes(data[at : at + width], "big")
    return (value & ((1 << 7 * width) - 1) if mask else value), width, at + width


def elements(data: bytes, at: int, end: int, ends_before: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, body, end) of each element. Unknown size: up to an element of the parent's level, or the parent's end."""
    while at < end:
        first = at
        kind, _, at = read_vint(data, at, mask=False)
        if kind in ends_before:
            return
        size, width, at = read_vint(data, at)
        if size == (1 << 7 * width) - 1:
            stop = unknown_end(data, at, end) if kind == CLUSTER else end
        elif (stop := at + size) > end:
            raise ValueError(f"element {kind:X} at byte {first} is longer than its parent")
        yield kind, first, at, stop
        at = stop


def unknown_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element that can't be inside one."""
    while at < end:
        kind, _, body = read_vint(data, at, mask=False)
        if kind in ABOVE_CLUSTERS:
            return at
        size, _, body = read_vint(data, body)
        at = body + size
    return end


def number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, size) of each frame of a block."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    for k in range(n - 1 if lacing != FIXED else 0):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, width, at = read_vint(data, at)
            size = value if k == 0 else sizes[-1] + value - (1 << 7 * width - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Packets, cues and tracks of a Matroska file."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the data end inside an element: {e}") from e


def _parse(data: bytes) -> Media:
    media = Media([], [], [], [])
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for kind, _, base, stop in top:
        if kind != SEGMENT:
            continue
        scale, cues = 1_000_000, []
        for kind, first, at, end in elements(data, base, stop):
            if kind == INFO:
                scale = next((number(data, a, b) for k, _, a, b in elements(data, at, end) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                media.tracks.extend(number(data, a, b) for k, _, x, y in elements(data, at, end) if k == TRACK_ENTRY for k, _, a, b in elements(data, x, y) if k == TRACK_NUMBER)
            elif kind == CLUSTER:
                media.clusters.append(first)
                read_cluster(data, at, end, scale, media)
            elif kind == CUES:
                cues += [cue for k, _, x, y in elements(data, at, end) if k == CUE_POINT for cue in cue_point(data, x, y)]
        media.cues.extend((time * scale // 1_000_000, track, base + cluster) for time, track, cluster in cues)
    return media


def cue_point(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(time, track, cluster position) for each track position of a cue point."""
    inside = [(k, a, b) for k, _, a, b in elements(data, at, end)]
    times = [number(data, a, b) for k, a, b in inside if k == CUE_TIME]
    places = [{k: number(data, x, y) for k, _, x, y in elements(data, a, b)} for k, a, b in inside if k == CUE_POSITIONS]
    if not times or not places or any(CUE_TRACK not in p or CUE_CLUSTER not in p for p in places):
        raise ValueError(f"the cue point before byte {end} lacks its time or a position")
    return [(times[0], p[CUE_TRACK], p[CUE_CLUSTER]) for p in places]


def read_cluster(data: bytes, at: int, end: int, scale: int, media: Media) -> None:
    base = 0
    for kind, _, a, b in elements(data, at, end):
        if kind == TIMESTAMP:
            base = number(data, a, b)
        group = list(elements(data, a, b)) if kind == BLOCK_GROUP else []
        # a block of a group is a key frame if it refers to no other
        alone = not any(k == REFERENCE for k, _, _, _ in group)
        for x, y in [(a, b)] if kind == SIMPLE_BLOCK else [(x, y) for k, _, x, y in group if k == BLOCK]:
            track, _, x = read_vint(data, x)
            offset, flags = struct.unpack_from(">hB", data, x)
            lacing = flags >> 1 & 3
            for start, size in frame_ranges(data, x + 3, y, lacing):
                media.packets.append(Packet(len(media.packets), track, (base + offset) * scale // 1_000_000, start, size, len(media.clusters) - 1, lacing, alone if kind == BLOCK_GROUP else bool(flags & 0x80)))


MEDIA = "doc_id long, n_bytes long, media binary"
PACKETS = "doc_id long, packet_no int, track int, timestamp_ms long, start long, size long, cluster_no int, lacing int, keyframe boolean, error string"
SUMMARY = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _few(batch):
            media = [encode_media(pad(t.as_py())) for t in part.column("text")]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t.as_py()) for t in part.column("text")], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of one stays small."""
    for at in range(0, batch.num_rows, 256):
        yield batch.slice(at, 256)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media of each row, stored in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return stored(rows.mapInArrow(_encode, MEDIA), compression="zstd")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            try:
                rows = [(doc_id, *p, None) for p in (parse(data.as_py()).packets if data.is_valid else [])]
            except ValueError as e:
                rows = [(doc_id, *[None] * len(Packet._fields), str(e))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *Packet._fields, "error"])


def packets(media: DataFrame) -> DataFrame:
    """A row for each packet of each file of a table with doc_id and media; error is null but for broken files."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_packets, PACKETS)


def features(media: Media, samples: np.ndarray) -> str:
    """Counts of the container and whole-number features of the samples."""
    level = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(level))))
    laces = np.bincount([p.lacing for p in media.packets], minlength=4).tolist()
    clusters = set(media.clusters)
    seekable = sum(at in clusters for _, _, at in media.cues)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={seekable};laces={','.join(map(str, laces))};last_ms={media.packets[-1].timestamp_ms if media.packets else 0};sum={int(level.sum())};energy={int((level * level).sum())};crossings={crossings}"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
            doc_id, n_bytes, data = (x.as_py() for x in row)
            media = parse(data)
            payload = b"".join(data[p.start : p.start + p.size] for p in media.packets if p.track == TRACK)
            out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(media, np.frombuffer(payload, np.uint8))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def read_media(media: DataFrame) -> DataFrame:
    """What op10 returns: the payload read back from the packets' byte ranges, and features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_summaries, SUMMARY)
