"""Arrays of numbers as compressed blobs."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of equal weight stand together."""
    out = [np.array([len(arrays), *(v for a in arrays for v in (a.dtype.itemsize, len(a)))], np.int64).tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    at, out = 8 * (1 + 2 * n), []
    for kind, width, size in zip(kinds, head[1::2].tolist(), head[2::2].tolist()):
        flat = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(flat.T).reshape(-1).view(kind) if size else np.zeros(0, kind))
        at += width * size
    return out
