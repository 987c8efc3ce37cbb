"""Matroska media columns: a writer, and a parser into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes
included), the segment's info, tracks, clusters, simple blocks and block groups,
all four lacing modes, and cues; it gives a row for each packet: track, time,
flags, and the byte range in the file. Elements that it doesn't know are skipped
by their size; a truncated file gives the packets before the break.

The writer stores bytes as 8-bit PCM packets: 576 samples a packet, 8 packets a
laced block (EBML lacing; Xiph or fixed-size by parameter), clusters of 16
blocks, a cue for each cluster.
"""
from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

PACKET = 576
PER_BLOCK, PER_CLUSTER = 8, 16
RATE = 8000
#: Element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, DURATION_OF_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, VOID = 0x4282, 0xEC
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469, SEGMENT}

LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


# Writing


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(i: int, data: bytes) -> bytes:
    return _id(i) + _vint(len(data)) + data


def _uint(i: int, n: int) -> bytes:
    return _element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: str) -> bytes:
    if len(frames) == 1:
        return b"\0" + frames[0]
    mode = LACING[lacing]
    head = bytes([mode << 1, len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += _vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_media(payload: bytes, packet: int = PACKET, lacing: str = "ebml", track: int = 1) -> bytes:
    """A Matroska file that holds ``payload`` as 8-bit PCM packets."""
    step = packet * 1000 // RATE
    header = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(0x4D80, b"tagloom") + _element(0x5741, b"tagloom"))
    audio = _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8)
    entry = _uint(TRACK_NUMBER, track) + _uint(0x73C5, track) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, step * 1_000_000)
    tracks = _element(TRACKS, _element(TRACK_ENTRY, entry + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, audio)))
    parts = [info, tracks]
    at = len(info) + len(tracks)
    frames = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    cues = []
    per = PER_BLOCK * PER_CLUSTER
    for c in range(0, len(frames), per):
        body = [_uint(TIMESTAMP, c * step)]
        group = frames[c : c + per]
        for k in range(0, len(group), PER_BLOCK):
            laced = _laced(group[k : k + PER_BLOCK], lacing)
            body.append(_element(SIMPLE_BLOCK, _vint(track) + struct.pack(">h", k * step) + bytes([0x80 | laced[0]]) + laced[1:]))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * step) + _element(CUE_POSITIONS, _uint(CUE_TRACK, track) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(parts))


# Parsing


class _Broken(Exception):
    pass


def _read_id(b: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not b[at]:
        raise _Broken
    width = 9 - b[at].bit_length()
    if width > 4 or at + width > end:
        raise _Broken
    return int.from_bytes(b[at : at + width], "big"), at + width


def _read_size(b: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(size, next position); None: unknown size."""
    if at >= end or not b[at]:
        raise _Broken
    width = 9 - b[at].bit_length()
    if at + width > end:
        raise _Broken
    n = int.from_bytes(b[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _children(b: bytes, at: int, end: int):
    """(id, start of data, end of data, whether it is complete) of each element."""
    while at < end:
        i, p = _read_id(b, at, end)
        size, p = _read_size(b, p, end)
        stop = end if size is None else p + size
        yield i, p, min(stop, end), stop <= end, size is None
        at = stop


def _number(b: bytes, a: int, e: int) -> int:
    return int.from_bytes(b[a:e], "big")


def _lace_sizes(b: bytes, at: int, end: int, mode: int) -> tuple[list[int], int]:
    n = b[at] + 1
    at += 1
    if mode == 2:
        if (end - at) % n:
            raise _Broken
        return [(end - at) // n] * n, at
    sizes = []
    if mode == 1:
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + b[at])
            at += 1
    else:
        for k in range(n - 1):
            p = at
            v, at = _read_size(b, at, end)
            if v is None:
                raise _Broken
            sizes.append(v if not k else sizes[-1] + v - (1 << 7 * (at - p) - 1) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise _Broken
    return sizes, at


def _block(b: bytes, a: int, e: int, base: int, group: bool, durations, packets) -> None:
    track, p = _read_size(b, a, e)
    if track is None or p + 3 > e:
        raise _Broken
    time, flags = struct.unpack_from(">hB", b, p)
    p += 3
    mode = flags >> 1 & 3
    try:
        sizes, p = ([e - p], p) if not mode else _lace_sizes(b, p, e, mode)
    except IndexError:
        raise _Broken from None
    step = durations.get(track, 0)
    for k, n in enumerate(sizes):
        packets.append((track, base + time + k * step, p, n, bool(flags & 0x80) or group, k))
        p += n


def parse_media(b: bytes) -> dict:
    """{packets: [(track, ms, offset, size, key, lace index)], cues: [(time, track, offset)], clusters, scale, codecs}."""
    out = {"packets": [], "cues": [], "clusters": 0, "scale": 1_000_000, "codecs": {}, "complete": True}
    durations: dict[int, int] = {}

    def cluster(a, e, unknown):
        base = 0
        for i, p, q, whole, _ in _children(b, a, e):
            if unknown and i in _TOP:
                return p, i
            if i == TIMESTAMP:
                base = _number(b, p, q)
            elif i == SIMPLE_BLOCK and whole:
                _block(b, p, q, base, False, durations, out["packets"])
            elif i == BLOCK_GROUP:
                kids = list(_children(b, p, q))
                for j, x, y, w, _ in kids:
                    if j == BLOCK and w:
                        _block(b, x, y, base, not any(k[0] == 0xFB for k in kids), durations, out["packets"])
            if not whole:
                raise _Broken
        return None

    def segment(a, e):
        at = a
        while at < e:
            start = at
            i, p = _read_id(b, at, e)
            size, p = _read_size(b, p, e)
            q = e if size is None else min(e, p + size)
            at = q
            if i == INFO:
                for j, x, y, _, _ in _children(b, p, q):
                    if j == SCALE:
                        out["scale"] = _number(b, x, y)
            elif i == TRACKS:
                for j, x, y, _, _ in _children(b, p, q):
                    if j == TRACK_ENTRY:
                        got = {k: (u, v) for k, u, v, _, _ in _children(b, x, y)}
                        n = _number(b, *got[TRACK_NUMBER]) if TRACK_NUMBER in got else 0
                        if CODEC in got:
                            out["codecs"][n] = b[slice(*got[CODEC])].decode("ascii", "replace")
                        if DEFAULT_DURATION in got:
                            durations[n] = _number(b, *got[DEFAULT_DURATION]) // max(1, out["scale"])
            elif i == CLUSTER:
                out["clusters"] += 1
                met = cluster(p, q, size is None)
                if met:  # an unknown-sized cluster ends where the next top element begins
                    at = b.index(_id(met[1]), start + 1, met[0])
                    while at < met[0] and _read_size(b, at + len(_id(met[1])), e)[1] != met[0]:
                        at = b.index(_id(met[1]), at + 1, met[0])
            elif i == CUES:
                for j, x, y, _, _ in _children(b, p, q):
                    if j == CUE_POINT:
                        got = {k: (u, v) for k, u, v, _, _ in _children(b, x, y)}
                        if CUE_TIME in got and CUE_POSITIONS in got:
                            pos = {k: _number(b, u, v) for k, u, v, _, _ in _children(b, *got[CUE_POSITIONS])}
                            out["cues"].append((_number(b, *got[CUE_TIME]), pos.get(CUE_TRACK, 0), a + pos.get(CUE_CLUSTER, 0)))
            if size is not None and p + size > e:
                raise _Broken

    try:
        for i, p, q, whole, _ in _children(b, 0, len(b)):
            if i == SEGMENT:
                segment(p, q)
            if not whole:
                raise _Broken
    except _Broken:
        out["complete"] = False
    return out


# Columns


def payload_of(text: str | None, packet: int = PACKET) -> tuple[bytes, int]:
    """Text as UTF-8, padded with bytes 255 to a positive multiple of ``packet``; unpadded size."""
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // packet)) * packet
    return raw + b"\xff" * (size - len(raw)), len(raw)


def store_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lacing: str = "ebml") -> DataFrame:
    """``keep``, n_bytes, media binary: each whole text as a Matroska file.

    Null texts count as empty; an empty text is one packet of padding. One row
    per row of ``docs``; equal texts give equal files. Extra columns are ignored.
    """
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", n_bytes bigint, media binary"

    def run(batches):
        for b in sliced(batches):
            made = [payload_of(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[: len(keep)],
                    pa.array([n for _, n in made], pa.int64()),
                    pa.array([write_media(p, lacing=lacing) for p, _ in made], pa.binary()),
                ],
                [*keep, "n_bytes", "media"],
            )

    return docs.select(*keep, F.col(text).cast("string").alias("_media_text")).mapInArrow(run, schema)


def packet_table(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: ``keep``, track, time_ms, offset, size, keyframe, lace.

    Null and empty media, and media that are no Matroska, have no packets.
    """
    schema = (
        ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keep)
        + ", track int, time_ms bigint, offset bigint, size bigint, keyframe boolean, lace int"
    )
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    names = [*keep, "track", "time_ms", "offset", "size", "keyframe", "lace"]

    def run(batches):
        for b in sliced(batches):
            rows = [parse_media(m)["packets"] if m else [] for m in b.column(len(keep)).to_pylist()]
            at = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64())
            flat = [p for r in rows for p in r]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in b.columns[: len(keep)]], *[pa.array([p[k] for p in flat], t) for k, t in enumerate(kinds)]],
                names,
            )

    return media.select(*keep, column).mapInArrow(run, schema)


def media_features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and what the stored bytes hold, read back through the packet table."""
    schema = (
        ", ".join(f"`{k}` {media.schema[k].dataType.simpleString()}" for k in keep)
        + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in sliced(batches):
            rows = []
            for m in b.column(len(keep)).to_pylist():
                m = m or b""
                got = parse_media(m)
                packets = got["packets"]
                payload = b"".join([m[p[2] : p[2] + p[3]] for p in packets])
                good = sum(m[o : o + 4] == _id(CLUSTER) for _, _, o in got["cues"])
                feature = (
                    f"packets={len(packets)};clusters={got['clusters']};cues={good};tracks={len(got['codecs'])};"
                    f"end_ms={packets[-1][1] if packets else 0};mean={sum(payload) / max(1, len(payload)):.3f}"
                )
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature)
                )
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names)

    return media.select(*keep, column).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))
