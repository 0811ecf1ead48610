"""Media columns: ISO media containers as binary columns, and what can be known of them without decoding payloads.

store() writes bytes as the frames of an uncompressed 8-bit grey video track; probe() walks the nested boxes of any
ISO media file, decodes its sample tables, those of movie fragments too, and gives codec, duration and the byte ranges of key frames.
Payloads are never decoded: samples() cuts them out of the file by the ranges that the tables state.

Results in special cases: a null text counts as empty; an empty text still makes one frame of padding; repeated rows
each give a row; an empty table gives an empty one; other columns are ignored, whatever their names. Bytes that aren't
an ISO media file, whose boxes nest deeper than MOST_NESTED, or whose tables state more than the file holds or point outside it,
give nulls in probe()'s columns and the error in `error`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, text_or_empty

WIDTH = HEIGHT = 24
#: Bytes of a frame: 8-bit grey.
FRAME = WIDTH * HEIGHT
RATE, PER_CHUNK, KEY_EVERY, PAD = 25, 16, 12, b"\xff"
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MOST_NESTED = 32
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """data with bytes 255 appended up to a positive multiple of unit."""
    return data + PAD * (unit - len(data) if len(data) < unit else -len(data) % unit)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def muxed(payload: bytes) -> bytes:
    """An ISO media file whose single raw video track has payload as its frames; len(payload) is a multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIHB31sHh", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, 0, b"", 40, -1))
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    head = len(ftyp)
    wide = len(payload) + head + 4096 + 8 * chunks >= 1 << 32

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
        table = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            table,
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), box(b"trak", tkhd, mdia))

    size = len(moov(0))
    mdat = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(head + size + mdat) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, start of the body, end) of every box, containers before what they hold."""
    if len(path) > MOST_NESTED:
        raise ValueError("boxes are nested too deeply")
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} ends outside its parent")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


@dataclass
class Track:
    """What the tables of a track state; offsets and sizes are those of its samples in decoding order."""

    codec: str
    handler: str
    timescale: int
    duration: int
    width: int
    height: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray


def tracks(file: bytes) -> list[Track]:
    data = memoryview(file)
    if len(file) < 8:
        raise ValueError("no boxes")
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int]] = {}  # track: the body of its trex
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []  # start of each moof, and the boxes of its trafs
    for path, start, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (start, end))
        elif path == (b"moov", b"mvex", b"trex"):
            defaults[struct.unpack_from(">I", data, start + 4)[0]] = (start, end)
        elif path == (b"moof",):
            fragments.append((start - 8, []))
        elif path[:2] == (b"moof", b"traf"):
            fragments[-1][1].append((path[-1], start, end))
    if not found:
        raise ValueError("no track")
    out = [_track(data, t) for t in found]
    if fragments:
        by_id = {struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] else 12))[0]: k for k, t in enumerate(found)}
        _add_fragments(data, fragments, defaults, by_id, out)
    return out


def _add_fragments(data: memoryview, fragments: list, defaults: dict, by_id: dict[int, int], out: list[Track]) -> None:
    """Appends the samples that movie fragments list to their tracks."""
    more: dict[int, tuple[list, list, list, list]] = {k: ([], [], [], []) for k in by_id.values()}
    for moof, boxes in fragments:
        base, at, size, length, flags, k = moof, moof, 0, 0, 0, -1
        for kind, start, end in boxes:
            if kind == b"tfhd":
                bits, track = struct.unpack_from(">II", data, start)
                k, p = by_id[track], start + 8
                trex = defaults.get(track)
                length, size, flags = struct.unpack_from(">III", data, trex[0] + 12) if trex else (0, 0, 0)
                base = moof if bits & 0x20000 or k < 0 else at
                if bits & 1:
                    (base,), p = struct.unpack_from(">Q", data, p), p + 8
                p += 4 * bool(bits & 2)
                if bits & 8:
                    (length,), p = struct.unpack_from(">I", data, p), p + 4
                if bits & 0x10:
                    (size,), p = struct.unpack_from(">I", data, p), p + 4
                if bits & 0x20:
                    (flags,), p = struct.unpack_from(">I", data, p), p + 4
                at = base
            elif kind == b"trun":
                if k < 0:
                    raise ValueError("a run before its header")
                bits, n = struct.unpack_from(">II", data, start)
                p = start + 8
                if bits & 1:
                    at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
                first = None
                if bits & 4:
                    (first,), p = struct.unpack_from(">I", data, p), p + 4
                fields = [b for b in (0x100, 0x200, 0x400, 0x800) if bits & b]
                if p + 4 * len(fields) * n > end or (not fields and n > len(data)):
                    raise ValueError("a run is cut short")
                table = np.frombuffer(data, ">u4", n * len(fields), p).astype(np.int64).reshape(n, len(fields))
                of = lambda b, same: table[:, fields.index(b)] if b in fields else np.full(n, same, np.int64)  # noqa: B023, E731
                sizes, marks = of(0x200, size), of(0x400, flags)
                if first is not None and n and 0x400 not in fields:
                    marks[0] = first
                offsets, lengths, sized, keys = more[k]
                offsets.append(at + np.cumsum(sizes) - sizes)
                lengths.append(of(0x100, length))
                sized.append(sizes)
                keys.append(marks & 0x10000 == 0)
                at += int(sizes.sum())
    for k, (offsets, lengths, sized, keys) in more.items():
        if offsets:
            t, n = out[k], len(out[k].sizes)
            t.offsets, t.sizes = np.concatenate([t.offsets, *offsets]), np.concatenate([t.sizes, *sized])
            t.keys = np.concatenate([t.keys, n + np.flatnonzero(np.concatenate(keys))])
            t.duration = max(t.duration, int(sum(x.sum() for x in lengths)) + (t.duration if n else 0))
            _inside(data, t)


def _inside(data: memoryview, t: Track) -> None:
    if len(t.sizes) and (t.offsets.min() < 0 or (t.offsets + t.sizes).max() > len(data)):
        raise ValueError("samples outside the file")
    if len(t.keys) and (t.keys.min() < 0 or t.keys.max() >= len(t.sizes)):
        raise ValueError("a key frame that isn't a sample")
    if t.sizes.sum() > len(data):
        raise ValueError("the samples are larger than the file")


def _track(data: memoryview, t: dict[bytes, tuple[int, int]]) -> Track:
    def ints(kind: bytes, skip: int, width: int = 1, dtype: str = ">u4") -> np.ndarray:
        at = t[kind][0] + skip
        (n,) = struct.unpack_from(">I", data, at - 4)
        if at + n * width * np.dtype(dtype).itemsize > t[kind][1]:
            raise ValueError(f"{kind!r} is cut short")
        return np.frombuffer(data, dtype, n * width, at).astype(np.int64).reshape(n, width)

    at = t[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
    at = t[b"stsd"][0] + 8
    codec = bytes(data[at + 4 : at + 8]).decode("latin-1")
    handler = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1")
    width, height = struct.unpack_from(">HH", data, at + 32) if handler == "vide" else (0, 0)
    if b"stsz" in t:
        same, n = struct.unpack_from(">II", data, t[b"stsz"][0] + 4)
        if n * same > len(data):
            raise ValueError("the samples are larger than the file")
        sizes = np.full(n, same, np.int64) if same else ints(b"stsz", 12)[:, 0]
    else:
        raise ValueError("no sample sizes")
    chunks = ints(b"co64", 8, 1, ">u8")[:, 0] if b"co64" in t else ints(b"stco", 8)[:, 0]
    runs = ints(b"stsc", 8, 3)
    steps = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(runs) and (steps.min() < 0 or steps.sum() > len(chunks)):
        raise ValueError("runs of chunks that aren't there")
    each = np.repeat(runs[:, 1], steps) if len(runs) else np.zeros(0, np.int64)
    if each.sum() != len(sizes):
        raise ValueError("the chunks hold another number of samples than there are sizes")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    offsets = np.repeat(chunks, each) + before - np.repeat(before[first[each > 0]] if len(sizes) else before, each[each > 0])
    keys = ints(b"stss", 8)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
    out = Track(codec, handler, timescale, duration, width, height, offsets, sizes, keys)
    _inside(data, out)
    return out


def samples(file: bytes, track: Track) -> bytes:
    """The track's samples, one after the other; neighbours in the file are cut out together."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(file[a:b] for a, b in zip(track.offsets[[0, *cut]].tolist(), ends[[*(cut - 1), -1]].tolist(), strict=True))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): each text's UTF-8 bytes, padded, as the frames of an ISO media file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([muxed(padded(x)) for x in data], pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = "codec string, width int, height int, n_samples long, timescale long, duration long, keyframes array<struct<offset:long,length:long>>, payload binary, error string"


def probe(files: DataFrame, media_col: str = "media") -> DataFrame:
    """files with FEATURES of the first track of each file; files' columns must not have their names, FEATURES' ones stay last."""
    small_batches(files.sparkSession)
    at = files.columns.index(media_col)
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def one(file: bytes | None) -> tuple:
        if file is None:
            return (*[None] * 8, "null")
        try:
            t = tracks(file)[0]
            keys = [{"offset": o, "length": n} for o, n in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), strict=True)]
            return t.codec, t.width, t.height, len(t.sizes), t.timescale, t.duration, keys, samples(file, t), None
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (*[None] * 8, f"{type(e).__name__}: {e}")

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), ranges, pa.binary(), pa.string()]
    names = [x.split(" ")[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=[*batch.schema.names, *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{head}, {FEATURES}")
