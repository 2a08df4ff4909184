"""Pixel arrays: numpy in Arrow batches. An image is (width, height, format, pixels), rows first, channels interleaved."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Channels of each pixel format.
CHANNELS = {"gray": 1, "rgb": 3, "rgba": 4, "bgr": 3, "bgra": 4}
FILL = 114


def array(width: int, height: int, kind: str, pixels: bytes) -> np.ndarray:
    """height x width x channels; ValueError if the sizes do not agree."""
    if len(pixels) != width * height * CHANNELS[kind]:
        raise ValueError(f"{len(pixels)} bytes are no {width} x {height} {kind} image")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, CHANNELS[kind])


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixel: floor of the scaled place, within the image."""
    rows = np.minimum(np.arange(height) * a.shape[0] // height, a.shape[0] - 1)
    columns = np.minimum(np.arange(width) * a.shape[1] // width, a.shape[1] - 1)
    return a[rows][:, columns]


def resize_to_fit(a: np.ndarray, most: int) -> np.ndarray:
    h, w = a.shape[:2]
    if max(h, w) <= most:
        return a
    scale = most / max(h, w)
    return resize(a, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))


def letterbox(a: np.ndarray, side: int, fill: int = FILL) -> tuple[np.ndarray, float, int, int]:
    """(square image, scale, pad_x, pad_y): scaled down if need be, sides rounded, centred on a filled square."""
    h, w = a.shape[:2]
    scale = min(side / w, side / h, 1.0)
    nw, nh = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
    out = np.full((side, side, a.shape[2]), fill, np.uint8)
    x, y = (side - nw) // 2, (side - nh) // 2
    out[y : y + nh, x : x + nw] = resize(a, nw, nh)
    return out, scale, x, y


def normalize(a: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    """Channels first, (x / 255 - mean) / std as 32-bit floats, for as many channels as there are means."""
    n = min(len(mean), a.shape[2])
    x = a[:, :, :n].astype(np.float32) / np.float32(255)
    return ((x - np.array(mean[:n], np.float32)) / np.array(std[:n], np.float32)).transpose(2, 0, 1)


def normalized(images: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """images with `values`, array<float>, of normalize(): channel after channel, row after row."""
    fields = T.StructType([*images.schema.fields, T.StructField("values", T.ArrayType(T.FloatType()))])
    at = {c: images.columns.index(c) for c in ("width", "height", "format", "pixels")}

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for c, i in at.items()}
            made = [normalize(array(w, h, k, p), mean, std).ravel() for w, h, k, p in zip(columns["width"], columns["height"], columns["format"], columns["pixels"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float32()))], [*batch.schema.names, "values"])

    return images.mapInArrow(run, fields)


def row_bytes(width: Column, format: Column) -> Column:
    """Bytes of a row of pixels."""
    known = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    return width * F.try_element_at(known, format)


def pixel_at(pixels: str, x: int, y: int, width: int, channels: int = 1) -> Column:
    """The first channel of the pixel in column x and row y, 0 to 255; null outside."""
    return F.conv(F.hex(F.substring(pixels, (y * width + x) * channels + 1, 1)), 16, 10).cast("long")


def crop(a: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The rounded rectangle within the image; one black pixel if nothing is left."""
    left, top, width, height = (int(np.floor(v + 0.5)) for v in (x, y, w, h))
    left, top = max(0, left), max(0, top)
    out = a[top : max(top, min(a.shape[0], top + height)), left : max(left, min(a.shape[1], left + width))]
    return out if out.size else np.zeros((1, 1, a.shape[2]), np.uint8)


def swap_red_blue(a: np.ndarray) -> np.ndarray:
    return a[:, :, [2, 1, 0, *range(3, a.shape[2])]]


def drop_alpha(a: np.ndarray) -> np.ndarray:
    return a[:, :, :3]


def pad_to_stride(a: np.ndarray, stride: int) -> np.ndarray:
    h, w = a.shape[:2]
    return np.pad(a, ((0, -h % stride), (0, -w % stride), (0, 0)))


def grayscale(a: np.ndarray) -> np.ndarray:
    return (a[:, :, :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.uint8)


def encode_png(a: np.ndarray) -> bytes:
    """An RGBA, RGB or gray image as PNG."""
    h, w, n = a.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit PNG (not interlaced) or a binary PPM or PGM."""
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            fields.append(int(data[at:end]))
            at = end
        w, h, _ = fields
        n = 1 if data[:2] == b"P5" else 3
        a = np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape(h, w, n)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at, raw, head, palette = 8, b"", None, None
        while at < len(data):
            size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
            raw += body if kind == b"IDAT" else b""
            at += size + 12
        w, h, depth, color, _, _, interlace = head
        if depth != 8 or interlace:
            raise ValueError("only 8-bit images without interlacing are read")
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        flat = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * n)
        a = _unfilter(flat, n).reshape(h, w, n)
        if color == 3:
            a = palette[a[:, :, 0]]
        elif color == 4:
            a = np.concatenate([a[:, :, :1].repeat(3, 2), a[:, :, 1:]], axis=2)
    else:
        raise ValueError("unknown image format")
    if a.shape[2] == 1:
        a = a.repeat(3, 2)
    return a if a.shape[2] == 4 else np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], axis=2)


def _unfilter(flat: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((flat.shape[0] + 1, flat.shape[1] - 1), np.int64)
    for r, line in enumerate(flat.astype(np.int64), 1):
        kind, x, up = line[0], line[1:], out[r - 1]
        if kind == 2:
            out[r] = (x + up) & 255
        elif kind == 0:
            out[r] = x
        else:
            for i in range(len(x)):
                a, b, c = (out[r, i - n] if i >= n else 0), up[i], (up[i - n] if i >= n else 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[r, i] = (x[i] + guess) & 255
    return out[1:].astype(np.uint8)


def components(p: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of the four-neighbour components of a map above a threshold, in reading order of their first pixel."""
    on, out = p > threshold, []
    seen = np.zeros_like(on)
    for y, x in zip(*np.nonzero(on), strict=True):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            r, c = stack.pop()
            cells.append((r, c))
            for i, j in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= i < on.shape[0] and 0 <= j < on.shape[1] and on[i, j] and not seen[i, j]:
                    seen[i, j] = True
                    stack.append((i, j))
        rows, columns = zip(*cells, strict=True)
        out.append((int(min(columns)), int(min(rows)), int(max(columns) - min(columns) + 1), int(max(rows) - min(rows) + 1), len(cells)))
    return out


#: The eight neighbours (down, right) in turn, clockwise from the right.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def contours(p: np.ndarray, threshold: float = 0.3, most: int = 10_000) -> list[list[tuple[int, int]]]:
    """Outer boundaries (x, y) of the components above a threshold, each once, of four points or more."""
    on = p > threshold
    out = []
    for x, y, w, h, _ in components(p, threshold):
        row = y
        first = next(c for c in range(x, x + w) if on[row, c])
        at, facing, path = (row, first), 0, [(first, row)]
        for _ in range(most):
            for turn in range(8):
                d = (facing + 5 + turn) % 8
                r, c = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
                if 0 <= r < on.shape[0] and 0 <= c < on.shape[1] and on[r, c]:
                    at, facing = (r, c), d
                    break
            else:
                break
            if at == (row, first):
                break
            path.append((at[1], at[0]))
        if len(path) >= 4:
            out.append(path)
    return out


def map_images(df: DataFrame, change) -> DataFrame:
    """df (image_id, width, height, format, pixels) with change(array) applied; the format follows the channels."""

    def run(batches):
        kinds = {1: "gray", 3: "rgb", 4: "rgba"}
        for batch in batches:
            rows = []
            for i, w, h, kind, pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.ascontiguousarray(change(array(w, h, kind, pixels)))
                rows.append((i, a.shape[1], a.shape[0], kind if CHANNELS[kind] == a.shape[2] else kinds[a.shape[2]], a.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["image_id", "width", "height", "format", "pixels"])

    return df.select("image_id", "width", "height", "format", "pixels").mapInArrow(run, "image_id long, width int, height int, format string, pixels binary")


def ink_mask(a: np.ndarray) -> np.ndarray:
    """Where a gray image has ink: darker than its 95th percentile less 28, within 80 and 245; the border has none."""
    gray = a[:, :, 0]
    level = np.sort(gray, axis=None)[min(int(gray.size * 0.95), gray.size - 1)]
    mask = gray < min(max(int(level) - 28, 80), 245)
    edge = max(1, min(gray.shape) // 80)
    mask[:edge] = mask[-edge:] = False
    mask[:, :edge] = mask[:, -edge:] = False
    return mask


def row_bands(mask: np.ndarray) -> list[tuple[int, int]]:
    """Inclusive runs of rows with enough ink; close ones are merged, and those of a line's height are kept."""
    h, w = mask.shape
    inked = mask.sum(axis=1) >= max(3, int(0.006 * w))
    gap, bands = max(3, min(14, int(0.018 * h))), []
    for r in np.flatnonzero(inked).tolist():
        if bands and r <= bands[-1][1] + (gap if r > bands[-1][1] + 1 else 1):
            bands[-1] = (bands[-1][0], r)
        else:
            bands.append((r, r))
    return [(t, b) for t, b in bands if 4 <= b - t + 1 <= h / 2]


def line_groups(a: np.ndarray) -> list[np.ndarray]:
    """The lines of a formula crop, over its whole width; the crop itself if there are not two, nothing if it is too small."""
    h, w = a.shape[:2]
    if h < 24 or w < 12:
        return []
    gray = grayscale(a)[:, :, None] if a.shape[2] >= 3 else a
    bands = row_bands(ink_mask(gray))
    return [a[t : b + 1] for t, b in bands] if len(bands) >= 2 else [a]
