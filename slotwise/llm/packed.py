"""Arrays of whole numbers as small byte strings."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^63 - 1, compressed, each array as small as its numbers allow."""
    parts = []
    for column in columns:
        top = int(column.max()) if len(column) else 0
        kind = next(k for k in "BHIQ" if top < 1 << 8 * np.dtype(k).itemsize)
        # Bytes of equal weight lie side by side, which compresses better.
        data = np.ascontiguousarray(column.astype(f"<{np.dtype(kind).str[1:]}"))
        turned = data.view(np.uint8).reshape(len(column), data.itemsize).T.tobytes()
        parts.append(kind.encode() + len(column).to_bytes(8, "little") + turned)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(f"<{np.dtype(chr(raw[at])).str[1:]}"), int.from_bytes(raw[at + 1 : at + 9], "little")
        end = at + 9 + n * kind.itemsize
        turned = np.frombuffer(raw[at + 9 : end], dtype=np.uint8).reshape(kind.itemsize, n)
        found.append(np.ascontiguousarray(turned.T).view(kind).reshape(n).astype(np.int64))
        at = end
    return found
