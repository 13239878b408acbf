"""Media columns: GIF images decoded into timed frames with colour histograms.

:func:`decode_gif` reads the LZW code streams, applies global and local palettes, interlacing, disposal
and transparency, and gives every frame its start and duration. :func:`media_columns` does so for a binary
column, one row an image. :func:`encode_gif` writes the 8-bit samples of a payload as a grey animation, so that any bytes can be stored and
read back losslessly.

Decoding an LZW segment needs no loop over codes: a table entry is the output of its code and one more
byte, so every code is a reference to earlier output, and references are followed for all bytes at
once by pointer doubling.

Memory is bounded: a canvas or frame of more than ``MAX_PIXELS`` pixels, or an image of more than ``MAX_SAMPLES`` samples
in all, is an error, a code stream is expanded no further than its frame, and images are taken by ``SLICE_BYTES``.

Defined results for odd input: null media and media without a readable header give null columns and an ``error``; media that break off or
lack their trailer keep the frames before the break, beside the ``error``; an image without frames has 0 frames; an empty table gives no rows; repeated rows give repeated results; other columns are carried along by name if asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 192
#: Rows of a frame that encode_gif writes, and its duration in hundredths of a second.
FRAME_ROWS = 256
FRAME_DELAY = 10
#: Levels a channel is divided into by the histograms.
BINS = 8
MAX_CODE = 4096
MAX_PIXELS = 1 << 24
MAX_SAMPLES = 1 << 28
#: Bytes of media (or payload) that a worker takes at once, if more than one image.
SLICE_BYTES = 1 << 22


def _widths(n: int, first: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear code; ``first`` is the first free entry."""
    entries = first + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.floor(np.log2(np.minimum(entries, MAX_CODE - 1))).astype(np.int64) + 1)


def _first_widths(first: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if first not in cache:
        cache[first] = _widths(MAX_CODE + 8, first)
    return cache[first]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples, with a clear code whenever the table is full."""
    clear, stop = 256, 257
    table: dict[int, int] = {}
    get = table.get
    free = 258
    segments: list[list[int]] = []
    out = [clear]  # read with the first width; every later segment starts after its clear code
    segments.append(out)
    out = []
    segments.append(out)
    it = iter(samples)
    prefix = next(it, None)
    for byte in it:
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        out.append(prefix)
        if free < MAX_CODE:
            table[key] = free
            free += 1
        else:
            out.append(clear)
            table.clear()
            free = 258
            out = []
            segments.append(out)
        prefix = byte
    if prefix is not None:
        out.append(prefix)
    out.append(stop)
    codes, widths = [], []
    for segment in segments:
        codes.append(np.array(segment, np.uint16))
        widths.append(_first_widths(258)[: len(segment)])
    code, width = np.concatenate(codes), np.concatenate(widths)
    bits = (code[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _expand(codes: np.ndarray, first: int, limit: int) -> np.ndarray:
    """The output of the codes between two clear codes, ``limit`` bytes of it or a code more."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint8)
    literal = codes < first
    parent = np.where(literal, np.arange(n), codes - first)
    if (parent > np.arange(n)).any() or (parent[~literal] >= np.arange(n)[~literal]).any() or (codes[literal] >= first - 2).any():
        raise ValueError("LZW code out of range")
    # A code that isn't a literal stands for its parent's output and one byte more.
    up = parent
    length = (~literal).astype(np.int64)
    while not literal[up].all():
        length += length[up]
        up = up[up]
    length += 1
    end = np.cumsum(length)
    if end[-1] > limit:
        n = int(np.searchsorted(end, limit)) + 1
        codes, literal, parent, up, length, end = codes[: n + 1], literal[:n], parent[:n], up[:n], length[:n], end[:n]
    start = end - length
    source = np.arange(int(end[-1]), dtype=np.int32) - np.repeat((start - start[parent]).astype(np.int32), length)
    values = np.zeros(len(source), np.uint8)
    # The byte more is the first one of the code after the parent, which its root says.
    root = codes[up]
    values[end - 1] = np.where(literal, codes[:n], root[np.minimum(parent + 1, n - 1)])
    source[end - 1] = end - 1
    # All other bytes refer to the parent's; their chains are no longer than the parents' and halve with every step.
    for _ in range(int(length.max() - 1).bit_length()):
        source = source[source]
    return values[source]


def lzw_decode(data: bytes, min_code_size: int, limit: int = MAX_SAMPLES) -> np.ndarray:
    """The samples of a code stream, no more than about ``limit``."""
    if not 1 <= min_code_size <= 8:
        raise ValueError(f"code size {min_code_size}")
    clear = 1 << min_code_size
    stop, first = clear + 1, clear + 2
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total_bits = len(data) * 8
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    out: list[np.ndarray] = []
    bit = 0
    while bit < total_bits:
        n = MAX_CODE + 8
        while True:
            width = _first_widths(first) if n == MAX_CODE + 8 else _widths(n, first)
            ends = bit + np.cumsum(width)
            whole = int(np.searchsorted(ends, total_bits, "right"))
            at = (ends - width)[:whole]
            codes = window[at >> 3] >> (at & 7) & ((1 << width[:whole]) - 1)
            special = np.flatnonzero((codes == clear) | (codes == stop))
            if len(special) or whole < n:
                break
            n *= 2  # an encoder may leave a full table as it is
        k = int(special[0]) if len(special) else whole
        out.append(_expand(codes[:k], first, limit))
        limit -= len(out[-1])
        if not len(special) or codes[k] == stop or limit <= 0:
            break
        bit = int(ends[k])
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = FRAME_DELAY) -> bytes:
    """A grey animation whose palette indices are the payload; its length is a multiple of ``width``."""
    rows = len(payload) // width
    if rows * width != len(payload) or not rows:
        raise ValueError("the payload must be a positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i))]
    for top in range(0, rows, frame_rows):
        part = payload[top * width : (top + frame_rows) * width]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        stream = lzw_encode(part)
        out.append(b"\x08")
        out += [bytes([len(x)]) + x for x in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def frames_of(data: bytes) -> Iterator[dict]:
    """Frames with ``canvas`` (height, width, 4: RGB and opacity), ``samples`` (indices), times in ms and placement."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    if width * height > MAX_PIXELS:
        raise ValueError(f"canvas of {width} x {height} pixels")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, transparent, clock, index, left_over = 0, 0, -1, 0, 0, MAX_SAMPLES
    while True:
        if at >= len(data):
            raise ValueError("no trailer")
        if data[at] == 0x3B:
            return
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                control, delay, transparent = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = control >> 2 & 7, transparent if control & 1 else -1
            at = _blocks(data, at + 2)[1]
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        left_over -= w * h
        if w * h > MAX_PIXELS or left_over < 0:
            raise ValueError(f"frame of {w} x {h} pixels")
        palette = shared
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        if palette is None:
            raise ValueError("no palette")
        stream, end = _blocks(data, at + 1)
        samples = lzw_decode(stream, data[at], w * h)[: w * h]
        at = end
        if len(samples) < w * h:
            raise ValueError("short image data")
        samples = samples.reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            samples = samples[np.argsort(rows, kind="stable")]
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        seen = samples[: region.shape[0], : region.shape[1]]
        if seen.size and int(seen.max()) >= len(palette):
            raise ValueError("index beyond the palette")
        opaque = seen != transparent
        region[opaque, :3] = palette[seen[opaque]]
        region[opaque, 3] = 255
        yield {
            "index": index, "start_ms": clock, "duration_ms": 10 * delay, "disposal": disposal, "left": left, "top": top,
            "width": w, "height": h, "transparent": transparent, "samples": samples, "canvas": canvas,
        }
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        clock += 10 * delay
        index += 1
        disposal, delay, transparent = 0, 0, -1


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of the opaque pixels: ``BINS`` levels of red, then green, then blue."""
    seen = canvas[canvas[..., 3] > 0]
    return np.concatenate([np.bincount(seen[:, c] // (256 // BINS), minlength=BINS) for c in range(3)]).tolist()


def decode_gif(data: bytes) -> dict:
    """Width, height, frames with their histograms, all frames' samples one after another, and the error that ended them."""
    frames, samples, error = [], [], None
    try:
        for f in frames_of(data):
            samples.append(f.pop("samples").tobytes())
            frames.append(f | {"histogram": histogram(f.pop("canvas"))})
    except (ValueError, IndexError, struct.error) as e:
        error = str(e) or type(e).__name__
        if not frames and error != "no trailer":
            return {"error": error}
    width, height = struct.unpack_from("<HH", data, 6)
    return {"width": width, "height": height, "frames": frames, "samples": b"".join(samples), "error": error}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut by the bytes of its last column."""
    sizes, start, total = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_FRAME = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("index", "start_ms", "duration_ms", "disposal", "left", "top", "width", "height", "transparent")]
    + [T.StructField("histogram", T.ArrayType(T.LongType()))]
)
_MEDIA = T.StructType(
    [
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("frames", T.ArrayType(_FRAME)),
        T.StructField("samples", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
NAMES = tuple(f.name for f in _MEDIA.fields)


def media_columns(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``width, height, frames, samples, error`` of the GIFs in column ``media``, and the columns ``keep``."""
    kept = [F.col(f"`{c}`") for c in keep if c not in NAMES]
    schema = T.StructType([df.schema[c] for c in keep if c not in NAMES] + _MEDIA.fields)
    arrow = _arrow_media()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                media = part.column(part.num_columns - 1).to_pylist()
                rows = [decode_gif(x) if x is not None else {"error": "no media"} for x in media]
                columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *NAMES])

    return df.select(*kept, F.col(f"`{media}`").alias("_media")).mapInArrow(run, schema)


def _arrow_media() -> list[pa.Field]:
    frame = pa.struct([*[(f.name, pa.int64()) for f in _FRAME.fields[:-1]], ("histogram", pa.list_(pa.int64()))])
    return [
        pa.field("width", pa.int64()), pa.field("height", pa.int64()), pa.field("frames", pa.list_(frame)),
        pa.field("samples", pa.binary()), pa.field("error", pa.string()),
    ]


def payload_of(text: Column, width: int = WIDTH) -> Column:
    """The text's UTF-8 bytes, padded with spaces to a positive multiple of ``width``."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    return F.rpad(data, (F.greatest(F.ceil(n / width), F.lit(1)) * width).cast("int"), F.lit(b" "))


def stored_as_gif(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``media``: the payload column as a GIF."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                media = pa.array([encode_gif(x) for x in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], media], [*part.schema.names[:-1], "media"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(payload).alias("_payload")).mapInArrow(run, schema)
