"""Arrays of integers in few bytes, for blocks that are shuffled."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of longs, byte plane after byte plane, compressed; small or sorted and differenced values shrink most."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    raw = b"".join(planes)
    head = struct.pack(f"<B{len(arrays)}Q", len(arrays), *(len(a) for a in arrays))
    return head + pa.compress(raw, codec="zstd", asbytes=True) if raw else head


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack() was given."""
    sizes = struct.unpack_from(f"<{data[0]}Q", data, 1)
    at = 1 + 8 * len(sizes)
    raw = pa.decompress(data[at:], 8 * sum(sizes), codec="zstd", asbytes=True) if any(sizes) else b""
    out, begin = [], 0
    for n in sizes:
        planes = np.frombuffer(raw, np.uint8, 8 * n, begin).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.int64).reshape(n))
        begin += 8 * n
    return out
