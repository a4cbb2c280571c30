"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

Null media decode to null; media that are no GIF, or end early, give an `error` text and the frames read so far.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps

#: Pixels in a row of the frames that hold bytes, and rows of the largest such frame.
ROW, ROWS = 192, 256
#: Hundredths of a second that such a frame stays.
DELAY_CS = 10
MAX_CODES = 4096
#: Pixels of a canvas at most; its histogram takes some twenty bytes for each.
MAX_PIXELS = 1 << 24


def _widths(bits: int) -> np.ndarray:
    """Bits of the k-th code after a clear code, for code streams of `bits` bits a sample."""
    following = (1 << bits) + 2 + np.maximum(np.arange(MAX_CODES + 1) - 1, 0)
    return np.clip(np.ceil(np.log2(following + 1)).astype(np.int64), bits + 1, 12)


_WIDTHS = {b: _widths(b) for b in range(2, 9)}
_ENDS = {b: np.concatenate([[0], np.cumsum(w)]) for b, w in _WIDTHS.items()}


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths in one little-endian bit string."""
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.uint8)
    shifted = codes.astype(np.uint32) << (starts & 7).astype(np.uint32)
    for k in range(3):
        np.bitwise_or.at(out, (starts >> 3) + k, ((shifted >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The GIF code stream of samples below 1 << bits; the table is cleared whenever it is full."""
    clear = 1 << bits
    codes: list[int] = [clear]
    marks = [0]
    room = MAX_CODES - clear - 2
    known: dict[int, int] = {}
    get, put, left, next_code = known.get, codes.append, room, clear + 2
    stream = iter(samples)
    prefix = next(stream, None)
    if prefix is not None:
        for b in stream:
            key = prefix << 8 | b
            found = get(key)
            if found is not None:
                prefix = found
                continue
            put(prefix)
            prefix = b
            if left:
                known[key] = next_code
                next_code += 1
                left -= 1
            else:
                put(clear)
                marks.append(len(codes) - 1)
                known.clear()
                left, next_code = room, clear + 2
        put(prefix)
    put(clear + 1)
    # the code after a clear code is number 0 of its part; the clear code itself is the last of the part before
    index = np.arange(len(codes)) - 1
    for a, b in zip(marks, [*marks[1:], len(codes)], strict=True):
        index[a + 1 : b + 1] = np.arange(min(b, len(codes) - 1) - a)
    index[0] = 0
    return pack_codes(np.array(codes, np.uint32), _WIDTHS[bits][np.minimum(index, MAX_CODES)])


def _expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    base = (1 << bits) + 2
    n = len(codes)
    literal = codes < base - 2
    owner = np.where(literal, np.arange(n), codes - base)
    if n and (owner > np.arange(n)).any() or (~literal & (owner >= np.arange(n))).any():
        raise ValueError("a code precedes its table entry")
    depth = (~literal).astype(np.int64)
    jump = owner
    while (add := depth[jump]).any():
        depth = depth + add
        jump = jump[jump]
    size = depth + 1
    at = np.cumsum(size) - size
    total = int(size.sum())
    # each sample of a table string is a copy of an earlier sample; following the copies ends at a literal
    shift = np.repeat(at - at[owner], size)
    source = np.arange(total) - shift
    while True:
        following = source[source]
        if np.array_equal(following, source):
            break
        source = following
    start = np.repeat(codes, size)
    return start[source].astype(np.uint8)


def lzw_decode(data: bytes, bits: int, count: int) -> np.ndarray:
    """Up to `count` samples of a GIF code stream; fewer when the stream ends early."""
    if not 2 <= bits <= 8:
        raise ValueError(f"code size {bits}")
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, clear, at = 8 * len(data), 1 << bits, 0
    ends, parts, have = _ENDS[bits], [], 0
    while have < count:
        got: list[np.ndarray] = []
        closed = None
        while closed is None:
            first = not got
            widths = _WIDTHS[bits] if first else np.full(MAX_CODES + 1, 12)
            starts = at + (ends[:-1] if first else np.arange(MAX_CODES + 1) * 12)
            fits = int(np.searchsorted(starts + widths, total, "right"))
            starts, widths = starts[:fits], widths[:fits]
            p = starts >> 3
            window = raw[p] | raw[p + 1] << np.uint32(8) | raw[p + 2] << np.uint32(16)
            codes = ((window >> (starts & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)).astype(np.int64)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                closed = bool(codes[stop[0]] == clear + 1)
                at = int(starts[stop[0]] + widths[stop[0]])
                codes = codes[: stop[0]]
            elif fits <= MAX_CODES:
                closed = True
            else:
                at = int(starts[-1] + widths[-1])
            got.append(codes)
        whole = np.concatenate(got)
        if len(whole):
            parts.append(_expand(whole, bits))
            have += len(parts[-1])
        if closed:
            break
    return np.concatenate(parts)[:count] if parts else np.zeros(0, np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray
    palette: np.ndarray
    delay_cs: int = 0
    disposal: int = 0
    transparent: int = -1


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    palette: np.ndarray | None = None
    loops: int = -1
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) > 0:
        if at + 1 + n > len(data):
            raise IndexError("a block ends early")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise IndexError("a palette ends early")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _rows(height: int) -> np.ndarray:
    """Stored order of an interlaced image's rows."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> Gif:
    """Parse a GIF; what can't be read goes to `error`, the frames before it stay."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return Gif(0, 0, error="no GIF header")
    width, height, flags, background = struct.unpack_from("<HHBB", data, 6)
    gif = Gif(width, height, background)
    try:
        at = 13
        if flags & 0x80:
            gif.palette, at = _colours(data, at, flags)
        delay, disposal, transparent = 0, 0, -1
        while True:
            kind = data[at]
            if kind == 0x3B:
                break
            if kind == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                    gif.loops = struct.unpack_from("<H", body, 12)[0]
            elif kind == 0x2C:
                left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = gif.palette
                if packed & 0x80:
                    palette, at = _colours(data, at, packed)
                bits = data[at]
                body, at = _blocks(data, at + 1)
                samples = lzw_decode(body, bits, w * h)
                if len(samples) < w * h:
                    raise ValueError(f"{len(samples)} of {w * h} samples")
                if packed & 0x40:
                    rows = np.empty((h, w), np.uint8)
                    rows[_rows(h)] = samples.reshape(h, w)
                    samples = rows.reshape(-1)
                if palette is None:
                    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
                gif.frames.append(Frame(left, top, w, h, samples, palette, delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, -1
            else:
                raise ValueError(f"block {kind:#x}")
    except (IndexError, ValueError, struct.error) as e:
        gif.error = str(e) or type(e).__name__
    return gif


def canvases(gif: Gif) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the RGBA canvas as shown: transparent samples leave it, disposal acts before the next frame.

    The canvas ends where no frame reaches: what lies beyond stays empty, however large the screen is said to be.
    """
    high, wide = reach(gif)
    canvas = np.zeros((high, wide, 4), np.uint8)
    for f in gif.frames:
        box = (slice(f.top, min(f.top + f.height, high)), slice(f.left, min(f.left + f.width, wide)))
        before = canvas[box].copy() if f.disposal == 3 else None
        index = f.samples.reshape(f.height, f.width)[: max(0, high - f.top), : max(0, wide - f.left)]
        if index.size:
            colours = np.concatenate([f.palette[np.minimum(index, len(f.palette) - 1)], np.full((*index.shape, 1), 255, np.uint8)], axis=2)
            seen = index != f.transparent
            canvas[box][seen] = colours[seen]
        yield f, canvas.copy()
        if f.disposal == 2:
            canvas[box] = 0
        elif f.disposal == 3:
            canvas[box] = before


def reach(gif: Gif) -> tuple[int, int]:
    """Rows and columns of the screen that frames touch."""
    return min(gif.height, max((f.top + f.height for f in gif.frames), default=0)), min(gif.width, max((f.left + f.width for f in gif.frames), default=0))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by the two high bits of red, green and blue: 64 counts."""
    seen = canvas[..., 3] > 0
    rgb = (canvas[..., :3][seen] >> 6).astype(np.int64)
    return np.bincount(rgb @ np.array([16, 4, 1]), minlength=64)


def histograms(gif: Gif) -> Iterator[tuple[Frame, np.ndarray | None]]:
    """Each frame with the histogram of the canvas as shown.

    No canvas is needed for frames that cover all of it, nor for a first one inside it. One of over MAX_PIXELS is an
    error of the GIF, and its frames have no histogram.
    """
    inside = lambda f: f.left + f.width <= gif.width and f.top + f.height <= gif.height
    covers = lambda f: f.transparent < 0 and (f.left, f.top, f.width, f.height) == (0, 0, gif.width, gif.height)
    if all(map(covers, gif.frames)) or (len(gif.frames) == 1 and inside(gif.frames[0])):
        for f in gif.frames:
            cells = (np.minimum(f.palette, 255) >> 6).astype(np.int64) @ np.array([16, 4, 1])
            used = np.bincount(f.samples, minlength=256)
            if f.transparent >= 0:
                used[f.transparent] = 0
            used[len(cells) - 1] += used[len(cells) :].sum()
            yield f, np.bincount(cells, used[: len(cells)], minlength=64).astype(np.int64)
        return
    high, wide = reach(gif)
    if high * wide > MAX_PIXELS:
        gif.error = gif.error or f"a canvas of {wide} x {high}"
        yield from ((f, None) for f in gif.frames)
        return
    for f, canvas in canvases(gif):
        yield f, histogram(canvas)


def write_gif(frames: list[Frame], width: int, height: int, palette: np.ndarray, loops: int = 0) -> bytes:
    """A GIF with a global palette of 256 colours; frames with another palette carry theirs."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    if len(frames) > 1:
        out += [b"\x21\xff\x0bNETSCAPE2.0\x03\x01", struct.pack("<H", loops), b"\0"]
    for f in frames:
        own = f.palette is not palette
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent >= 0), f.delay_cs, max(f.transparent, 0)) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if own else 0))
        out += [f.palette.astype(np.uint8).tobytes()] if own else []
        stream = lzw_encode(f.samples.tobytes())
        out += [b"\x08", *(bytes([len(part)]) + part for part in (stream[k : k + 255] for k in range(0, len(stream), 255)))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
#: The palette that every second frame of a payload carries.
NEGATIVE = GREYS[::-1].copy()
#: The sample that payload frames let the canvas show through: a space.
CLEAR = 0x20


def payload_to_gif(payload: bytes) -> bytes:
    """Bytes (a multiple of ROW) as grey samples: frames of up to ROWS rows over each other.

    Spaces are transparent. In turn a frame stays, is cleared and gives way to what stood before it; every second one
    has a palette of its own. None of this touches the samples.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [rows[k : k + ROWS] for k in range(0, len(rows), ROWS)]
    frames = [Frame(0, 0, ROW, len(part), part.reshape(-1), NEGATIVE if k % 2 else GREYS, DELAY_CS, 1 + k % 3, CLEAR) for k, part in enumerate(parts)]
    return write_gif(frames, ROW, min(len(rows), ROWS), GREYS)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text, null as empty, padded with spaces to a positive multiple of ROW, as a GIF."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"

    def run(batches):
        for batch in steps(batches, text_col):
            sizes, media = [], []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(payload_to_gif(raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


FRAME = "array<struct<frame:int,start_cs:long,delay_cs:int,disposal:int,transparent:int,left:int,top:int,width:int,height:int,histogram:array<long>>>"


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with gif_width, gif_height, gif_loops, gif_error, gif_samples (all frames' stored samples) and gif_frames.

    gif_frames holds each frame's place, timing, disposal and the colour histogram of the canvas as shown. One GIF at
    a time is in memory. Null media: null in all new columns. Columns of these names in df give way.
    """
    new = ["gif_width", "gif_height", "gif_loops", "gif_error", "gif_samples", "gif_frames"]
    df = df.select([c for c in df.columns if c.lower() not in new])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    schema = ", ".join([*fields, "gif_width int", "gif_height int", "gif_loops int", "gif_error string", "gif_samples binary", f"gif_frames {FRAME}"])
    kind = pa.list_(pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), *[(k, pa.int32()) for k in ("delay_cs", "disposal", "transparent", "left", "top", "width", "height")], ("histogram", pa.list_(pa.int64()))]))

    def one(data):
        if data is None:
            return None, None, None, None, None, None
        gif, start, told = read_gif(data), 0, []
        for k, (f, counts) in enumerate(histograms(gif)):
            told.append({"frame": k, "start_cs": start, "delay_cs": f.delay_cs, "disposal": f.disposal, "transparent": f.transparent, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "histogram": None if counts is None else counts.tolist()})
            start += f.delay_cs
        return gif.width, gif.height, gif.loops, gif.error, b"".join(f.samples.tobytes() for f in gif.frames), told

    def run(batches):
        for batch in steps(batches, media_col):
            got = list(zip(*[one(x) for x in batch.column(media_col).to_pylist()], strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(x), k) for x, k in zip(got, kinds, strict=True)]], [*batch.schema.names, *new])

    return df.mapInArrow(run, schema)


def feature(frames: Column) -> Column:
    """Frames, time and the summed histogram of the four grey levels as text."""
    grey = F.array(*[F.aggregate(F.transform(frames, lambda f: F.coalesce(F.get(f["histogram"], F.lit(21 * k)), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b) for k in range(4)])
    time = F.aggregate(F.transform(frames, lambda f: f["delay_cs"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.concat_ws("|", F.size(frames).cast("string"), time.cast("string"), F.concat_ws(",", F.transform(grey, lambda x: x.cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """The op1 contract: every text stored as a GIF, read back from the stored bytes, and digested."""
    got = decode_media(encode_texts(docs))
    payload = F.col("gif_samples")
    return got.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature(F.col("gif_frames")).alias("feature"), F.size("gif_frames").alias("n_frames"), F.col("gif_error").alias("error"),
    )
