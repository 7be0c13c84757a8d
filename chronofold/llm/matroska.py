"""Media columns: Matroska files as packet tables.

``packets`` parses the variable-length EBML elements of a file: segments and clusters (also of
unknown size), simple blocks and block groups, the three kinds of lacing (Xiph, EBML, fixed size),
tracks (a default duration or else the sample rate spaces the frames of a lace) and cues, into one row
per frame with track, time, byte range and whether it is a key frame. ``mux`` writes
8-bit PCM samples as such a file: clusters of laced blocks with frames of ``FRAME`` samples, and
cues that point at the clusters.

Null and empty texts become one frame of padding; texts of any length are stored whole; equal
texts give equal files; repeated rows are stored each; other columns are not read; an empty table gives no rows. Bytes that are no Matroska file raise
ValueError in ``packets``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.arrow import chunks, map_batches

FRAME = 576
RATE = 8000
LACE = 16  # frames in a block
CLUSTER = 24  # blocks in a cluster: their times must fit 16 bits
SCALE = 1_000_000  # nanoseconds of a tick
#: Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TICKS, DURATION, WRITER, MUXER = 0x2AD7B1, 0x4489, 0x5741, 0x4D80
TRACK, NUMBER, UID, KIND, CODEC, LACING, AUDIO, FREQUENCY, CHANNELS, DEPTH, EACH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
PARENTS = frozenset({SEGMENT, CLUSTER_ID, GROUP, TRACKS, TRACK, AUDIO, INFO, CUES, CUE, CUE_PLACE})
#: What may stand in a cluster; any other element ends one of unknown size.
IN_CLUSTER = frozenset({TIME, SIMPLE, GROUP, 0x5854, 0xA7, 0xAB, 0xAF, 0xEC, 0xBF})


def id_bytes(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def size_bytes(n: int) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(i: int, body: bytes) -> bytes:
    return id_bytes(i) + size_bytes(len(body)) + body


def number(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
_TRACKS = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A file with ``payload``, a multiple of FRAME bytes, as 8-bit samples of one track."""
    frames = len(payload) // FRAME
    info = element(INFO, number(TICKS, SCALE) + element(DURATION, struct.pack(">d", frames * FRAME * 1000 / RATE)) + element(MUXER, b"chronofold") + element(WRITER, b"chronofold"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, frames, LACE * CLUSTER):
        start = c * FRAME * 1000 // RATE
        body = [number(TIME, start)]
        for b in range(c, min(c + LACE * CLUSTER, frames), LACE):
            n = min(LACE, frames - b)
            head = b"\x81" + struct.pack(">hB", b * FRAME * 1000 // RATE - start, 0x84 if n > 1 else 0x80)
            body.append(element(SIMPLE, head + (bytes([n - 1]) if n > 1 else b"") + payload[b * FRAME : (b + n) * FRAME]))
        cluster = element(CLUSTER_ID, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, start) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    track: int
    time: int
    begin: int
    end: int
    key: bool
    cluster: int


@dataclass
class Media:
    """What a file holds: packets in file order, tracks (number: codec, rate, depth), cues (time, track, byte of the cluster)."""

    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    duration: float = 0.0
    scale: int = SCALE
    clusters: int = 0


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at {at}")
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer (None: unknown size) and where it ends."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at {at}")
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``kind``: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for i in range(n - 1):
            value, new = read_size(data, at)
            if value is None:
                raise ValueError("a lace size is unknown")
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (new - at) - 1) - 1))
            at = new
    else:
        if (end - at) % n:
            raise ValueError("frames of one size do not fill the block")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end:
        raise ValueError("frames exceed their block")
    return [*out, (at, end)]


def packets(data: bytes) -> Media:
    """Parse one file."""
    media = Media()
    if read_id(data, 0)[0] != EBML:
        raise ValueError("not an EBML file")
    # open parents: (id, end, state), the state of clusters is their time, of groups whether a frame is referred to
    stack: list[list] = [[0, len(data), 0, False, 0, 0]]
    at, segment, cue, track = 0, 0, [0, 0, 0], {}
    while at < len(data):
        while len(stack) > 1 and at >= stack[-1][1]:
            _close(stack.pop(), media, cue, track)
        i, body = read_id(data, at)
        size, body = read_size(data, body)
        while len(stack) > 1 and stack[-1][0] == CLUSTER_ID and stack[-1][3] and i not in IN_CLUSTER:
            stack.pop()  # a cluster of unknown size ends where something else begins
        end = stack[-1][1] if size is None else body + size
        if end > len(data):
            raise ValueError(f"an element at {at} exceeds the file")
        if i in PARENTS:
            if i == SEGMENT:
                segment = body
            elif i == CLUSTER_ID:
                media.clusters += 1
            elif i == CUE:
                cue[0] = 0
            elif i == CUE_PLACE:
                cue[1:] = [0, 0]
            elif i == TRACK:
                track.clear()
            stack.append([i, end, 0, size is None, at - segment, len(media.packets)])
            at = body
            continue
        value = data[body:end]
        if i == TIME:
            stack[-1][2] = int.from_bytes(value, "big")
        elif i in (SIMPLE, BLOCK):
            owner, p = read_size(data, body)
            shift, flags = struct.unpack_from(">hB", data, p)
            cluster = next(x for x in reversed(stack) if x[0] == CLUSTER_ID)
            key = bool(flags & 0x80) if i == SIMPLE else True
            ranges = laced(data, p + 3, end, flags >> 1 & 3)
            kind = media.tracks.get(owner, {})
            step, each = 0.0, kind.get("each", 0) / media.scale
            if not each and kind.get("codec", "").startswith("A_PCM") and kind.get("rate"):
                step = 1e9 / media.scale * 8 / (kind["rate"] * kind.get("channels", 1) * kind.get("depth", 8))
            begun = 0
            for k, (a, b) in enumerate(ranges):
                media.packets.append(Packet(owner, cluster[2] + shift + int(begun * step + k * each), a, b, key, cluster[4]))
                begun += b - a
        elif i == REFERENCE:  # all frames of the group's block, whether it comes before or after
            group = next((x for x in reversed(stack) if x[0] == GROUP), None)
            if group is not None:
                group[2] = True
        elif i == DURATION:
            media.duration = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
        elif i == TICKS:
            media.scale = int.from_bytes(value, "big")
        elif i in (NUMBER, CHANNELS, DEPTH, KIND, EACH):
            track[{NUMBER: "number", CHANNELS: "channels", DEPTH: "depth", KIND: "kind", EACH: "each"}[i]] = int.from_bytes(value, "big")
        elif i == CODEC:
            track["codec"] = value.decode("ascii", "replace")
        elif i == FREQUENCY:
            track["rate"] = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
        elif i in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[{CUE_TIME: 0, CUE_TRACK: 1, CUE_CLUSTER: 2}[i]] = int.from_bytes(value, "big")
        at = end
    while len(stack) > 1:
        _close(stack.pop(), media, cue, track)
    return media


def _close(parent: list, media: Media, cue: list[int], track: dict) -> None:
    i, _, state, _, _, before = parent
    if i == CUE_PLACE:  # a point may have positions for several tracks
        media.cues.append(tuple(cue))
    elif i == TRACK:
        media.tracks[track.get("number", 0)] = dict(track)
    elif i == GROUP and state:
        for packet in media.packets[before:]:
            packet.key = False


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with 255 to a positive multiple of FRAME."""
    return text + b"\xff" * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def features(data: bytes, media: Media) -> tuple[bytes, str]:
    """The samples that a file holds, and what there is to say about them."""
    samples = b"".join([data[p.begin : p.end] for p in media.packets])
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    share = counts[counts > 0] / max(len(x), 1)
    text = f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};ms={media.duration:.3f};last_ms={media.packets[-1].time if media.packets else 0}"
    return samples, f"{text};mean={total / max(len(x), 1):.6f};rms={(squares / max(len(x), 1)) ** 0.5:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f}"


FIELDS = (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"))


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of each row: its text as a Matroska file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, text)):
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    return map_batches(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet: track, time in milliseconds, byte range, key frame, byte of its cluster in the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, column)):
            for owner, data in zip(batch.column(key), batch.column(column).to_pylist()):
                m = packets(data) if data else Media()
                rows = [(p.track, p.time * m.scale / 1e6, p.begin, p.end, p.key, p.cluster) for p in m.packets]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([owner.as_py()] * len(rows), batch.schema.field(key).type), *columns], names=[key, "track", "ms", "begin", "end", "key_frame", "cluster"])

    return map_batches(media.select(key, column), run, f"`{key}` {media.schema[key].dataType.simpleString()}, track long, ms double, begin long, end long, key_frame boolean, cluster long")


def digest(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Reads stored files back: digests of the samples and the file, and features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "media")):
            rows = []
            for data in batch.column("media").to_pylist():
                samples, feature = features(data, packets(data))
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *columns], names=[key, *(n for n, _ in FIELDS)])

    return map_batches(media, run, f"`{key}` {media.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in FIELDS))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
