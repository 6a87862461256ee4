"""Media columns: AVI files of motion-JPEG frames, written, parsed, decoded and cut into shots.

A payload is stored as 8-bit grey samples, ``WIDTH`` to a line, in frames of ``HEIGHT`` lines (the
last may have fewer), each a JPEG of its own: lossless process (SOF3), predictor 1, one restart
interval a line, so that lines decode independently of each other, many at once. The frames lie in
the ``movi`` list of a RIFF file whose ``idx1`` names each one's offset and size.

Reading goes the same way back from the bytes alone: chunks of the RIFF file, index, JPEG markers,
Huffman table, samples. A shot ends where the histogram difference of neighbouring frames is above
an adaptive threshold: the mean of the last ``RECENT`` differences plus ``SPREAD`` mean deviations,
and ``FLOOR`` at least. Each shot is a timed clip.

Defined results: a null or empty text is a payload of 64 zero bytes; equal payloads give equal
files; repeated rows give equal values; an empty table gives no rows; extra columns pass through if
asked for, whatever their names, but one that is named like a result is given up. Memory is that of one batch of rows plus one
chunk of lines.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped

WIDTH, HEIGHT, FPS = 64, 16, 25
#: Lines that are coded or decoded at once, and bytes of texts that are worked on together.
LINES, GROUP_BYTES = 16_384, 2 << 20
RECENT, SPREAD, FLOOR, BINS = 8, 3.0, 0.35, 16
#: One Huffman code of 4 bits for each of the difference categories 0 to 8.
CODE_BITS, CATEGORIES = 4, 9

RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("clips", T.ArrayType(T.StructType([T.StructField("clip", T.IntegerType()), T.StructField("start_ms", T.IntegerType()), T.StructField("end_ms", T.IntegerType()), T.StructField("first_frame", T.IntegerType()), T.StructField("frames", T.IntegerType())]))),
])


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255 (at index difference + 255)."""
    diff = np.arange(-255, 256)
    category = np.array([int(abs(d)).bit_length() for d in diff])
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    return (category << category) | extra, category + CODE_BITS


BITS, N_BITS = _code_table()


def code_lines(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each line, without markers, with stuffing."""
    left = np.concatenate((np.full((len(samples), 1), 128, dtype=np.int16), samples[:, :-1].astype(np.int16)), axis=1)
    index = samples.astype(np.int16) - left + 255
    n = N_BITS[index]
    pad = -n.sum(axis=1) % 8
    widest = CODE_BITS + CATEGORIES - 1
    n = np.concatenate((n, pad[:, None]), axis=1).astype(np.int8)
    value = np.concatenate((BITS[index], ((1 << pad) - 1)[:, None]), axis=1).astype(np.int16)  # pads with ones
    place = n[:, :, None] - 1 - np.arange(widest, dtype=np.int8)
    live = place >= 0
    bits = ((value[:, :, None] >> np.maximum(place, 0)) & 1).astype(np.uint8)[live]
    packed = np.packbits(bits)
    sizes = n.sum(axis=1, dtype=np.int64) // 8
    full = packed == 255
    if full.any():  # a zero byte follows each 255
        at = np.flatnonzero(full) + 1
        packed = np.insert(packed, at, 0)
        line = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes + np.bincount(line[full], minlength=len(sizes))
    data, ends = packed.tobytes(), np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def jpeg(lines: list[bytes]) -> bytes:
    """One frame; each line is a restart interval."""
    out = [
        b"\xff\xd8",
        struct.pack(">2sHBHHBBBB", b"\xff\xc3", 11, 8, len(lines), WIDTH, 1, 1, 0x11, 0),
        struct.pack(">2sHB", b"\xff\xc4", 19 + CATEGORIES, 0), bytes(CATEGORIES * (k == CODE_BITS) for k in range(1, 17)), bytes(range(CATEGORIES)),
        struct.pack(">2sHH", b"\xff\xdd", 4, WIDTH),
        struct.pack(">2sHBBBBBB", b"\xff\xda", 8, 1, 1, 0, 1, 0, 0),
    ]
    for k, line in enumerate(lines):
        if k:
            out.append(bytes((0xFF, 0xD0 + (k - 1) % 8)))
        out.append(line)
    return b"".join([*out, b"\xff\xd9"])


def avi(frames: list[bytes]) -> bytes:
    """A RIFF file with one stream of motion-JPEG and an index of its frames."""
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    large = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, large * FPS, 0, 0x10, len(frames), 0, 1, large, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), large, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    data, index, at = [], [], 4
    for f in frames:
        data.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(data[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(data)) + chunk(b"idx1", b"".join(index)))


def indexed_frames(data: bytes) -> tuple[list[bytes], float]:
    """The frames that ``idx1`` names, and the milliseconds of each."""
    name, size, kind = struct.unpack_from("<4sI4s", data)
    if name != b"RIFF" or kind != b"AVI " or size + 8 > len(data):
        raise ValueError("not a whole AVI file")
    at, movi, index, frame_ms = 12, None, [], 1000 / FPS
    while at + 8 <= size + 8:
        name, n = struct.unpack_from("<4sI", data, at)
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            frame_ms = struct.unpack_from("<I", data, at + 20)[0] / 1000
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at + 8 + k) for k in range(0, n, 16)]
        at += 8 + n + n % 2
    return [data[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in index if name == b"00dc"], frame_ms


def scan_of(frame: bytes) -> tuple[tuple[int, int, bytes], bytes]:
    """(height, width, Huffman table) and the entropy-coded bytes of a frame."""
    at, height, width, table = 2, 0, 0, b""
    while True:
        marker, n = struct.unpack_from(">HH", frame, at)
        if marker == 0xFFC3:
            height, width = struct.unpack_from(">HH", frame, at + 5)
        elif marker == 0xFFC4:
            table = frame[at + 5 : at + 2 + n]
        at += 2 + n
        if marker == 0xFFDA:
            return (height, width, table), frame[at:-2]


def look_up(table: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The longest code's bits; by that many bits ahead, the code's bits and its category."""
    counts, symbols = table[:16], table[16:]
    longest = max(k + 1 for k, c in enumerate(counts) if c)
    bits, category = np.zeros(1 << longest, dtype=np.int64), np.zeros(1 << longest, dtype=np.int64)
    code, seen = 0, 0
    for k, c in enumerate(counts[:longest]):
        for s in symbols[seen : seen + c]:
            a = code << (longest - k - 1)
            b = (code + 1) << (longest - k - 1)
            bits[a:b], category[a:b] = k + 1, s
            code += 1
        seen += c
        code <<= 1
    return longest, bits, category


def decode_scans(scans: list[bytes], width: int, table: bytes) -> np.ndarray:
    """The samples of all lines of all scans; the lines are decoded side by side."""
    longest, bits, category = look_up(table)
    raw = np.frombuffer(b"\xff\xd0".join(scans) + b"\0\0", dtype=np.uint8)
    after = np.flatnonzero(raw[:-1] == 255) + 1
    follow = raw[after]
    restart = after[(follow >= 0xD0) & (follow <= 0xD7)]
    gone = np.zeros(len(raw), dtype=bool)
    gone[after[follow == 0]] = True
    gone[restart] = gone[restart - 1] = True
    shift = np.cumsum(gone)
    data = raw[~gone].astype(np.int64)
    starts = np.concatenate(([0], restart + 1 - shift[restart]))
    data = np.concatenate((data, np.zeros(4, dtype=np.int64)))
    ahead = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.empty((len(starts), width), dtype=np.uint8)
    at, last = starts * 8, np.full(len(starts), 128, dtype=np.int64)
    for x in range(width):
        peek = (ahead[at >> 3] << (at & 7)) & 0xFFFFFFFF
        code = peek >> (32 - longest)
        used, cat = bits[code], category[code]
        extra = ((peek << used) & 0xFFFFFFFF) >> (32 - cat)
        last = last + np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
        at += used + cat
        out[:, x] = last
    return out


def shots(samples: np.ndarray, heights: list[int]) -> list[int]:
    """The first frame of each shot; ``samples`` are the lines of all frames."""
    frame = np.repeat(np.arange(len(heights)), np.array(heights) * samples.shape[1])
    hist = np.bincount(frame * BINS + (samples.ravel() >> 4), minlength=len(heights) * BINS).reshape(-1, BINS)
    hist = hist / hist.sum(axis=1, keepdims=True)
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, recent = [0], []
    for k, d in enumerate(change.tolist(), start=1):
        mean = sum(recent) / len(recent) if recent else 0.0
        deviation = sum(abs(x - mean) for x in recent) / len(recent) if recent else 0.0
        if d > max(FLOOR, mean + SPREAD * deviation):
            cuts.append(k)
            recent = []
        else:
            recent = [*recent[1 - RECENT :], d]
    return cuts


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\0" * ((-len(text) % WIDTH) or (0 if text else WIDTH))


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH)
    lines: list[bytes] = []
    for k in range(0, len(samples), LINES):
        lines += code_lines(samples[k : k + LINES])
    out, at = [], 0
    for p in payloads:
        n = len(p) // WIDTH
        out.append(avi([jpeg(lines[k : min(k + HEIGHT, at + n)]) for k in range(at, at + n, HEIGHT)]))
        at += n
    return out


def decode(files: list[bytes]) -> list[tuple[bytes, list[int], list[int], float]]:
    """(payload, heights of frames, first frames of shots, milliseconds of a frame) of each file."""
    kinds: dict[tuple[int, bytes], list[tuple[int, int, int, bytes]]] = {}
    heights: list[list[int]] = []
    times = []
    for k, data in enumerate(files):
        frames, ms = indexed_frames(data)
        times.append(ms)
        heights.append([])
        for f, frame in enumerate(frames):
            (height, width, table), scan = scan_of(frame)
            heights[-1].append(height)
            kinds.setdefault((width, table), []).append((k, f, height, scan))
    parts: list[list[np.ndarray]] = [[] for _ in files]
    for (width, table), scans in kinds.items():
        begin, held = 0, 0
        for k, s in enumerate(scans):
            held += s[2]
            if held >= LINES or k == len(scans) - 1:
                lines, at = decode_scans([x[3] for x in scans[begin : k + 1]], width, table), 0
                for x in scans[begin : k + 1]:
                    parts[x[0]].append(lines[at : at + x[2]])
                    at += x[2]
                begin, held = k + 1, 0
    out = []
    for p, h, ms in zip(parts, heights, times):
        samples = np.concatenate(p)
        out.append((samples.tobytes(), h, shots(samples, h), ms))
    return out


def describe(texts: list[bytes | None]) -> list[tuple]:
    """The values of ``RESULT`` for each text, from the stored bytes read back."""
    files = encode([payload_of(t) for t in texts])
    out = []
    for text, data, (payload, heights, cuts, ms) in zip(texts, files, decode(files)):
        ends = [*cuts[1:], len(heights)]
        clips = [{"clip": k, "start_ms": round(a * ms), "end_ms": round(b * ms), "first_frame": a, "frames": b - a} for k, (a, b) in enumerate(zip(cuts, ends))]
        feature = f"frames={len(heights)};shots={len(cuts)};longest={max(c['frames'] for c in clips)}"
        out.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, clips))
    return out


def media_columns(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with those of ``RESULT``; one row per row, no shuffle."""
    shipped(docs.sparkSession)
    keep = [c for c in keep if c not in RESULT.names]
    source = docs.select(F.struct(*keep).alias("_kept"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([source.schema["_kept"], *RESULT.fields])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("clip", "start_ms", "end_ms", "first_frame", "frames")]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            done, group, held = [], [], 0
            for k, text in enumerate(texts):
                group.append(text)
                held += len(text or b"")
                if held >= GROUP_BYTES or k == len(texts) - 1:
                    done += describe(group)
                    group, held = [], 0
            columns = zip(*done) if done else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=schema.names)

    return source.mapInArrow(run, schema).select("_kept.*", *RESULT.names)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each timed clip of what ``media_columns`` returns, with all but the feature columns."""
    kept = [c for c in media.columns if c not in RESULT.names or c == "media_sha256"]
    return media.select(*kept, F.explode("clips").alias("_clip")).select(*kept, "_clip.*")
