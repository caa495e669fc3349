"""Minimal 8-bit PNG writer (gray or RGB)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png_bytes(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    colour = 0 if image.ndim == 2 else 2
    raw = b"".join(b"\0" + np.ascontiguousarray(row).tobytes() for row in image)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def blocks(h: int, w: int, *inked: tuple[int, int]) -> np.ndarray:
    """White line with black columns ``[a, b)`` in all but the outer two rows."""
    image = np.full((h, w), 255, dtype=np.uint8)
    for a, b in inked:
        image[2:h - 2, a:b] = 0
    return image
