"""PNG files as pixels, from the format's public specification: chunks, one zlib stream, and five row filters.

All colour types and bit depths, interlaced or not. Transparency is dropped, 16 bits a sample become 8, and palettes and grey become RGB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel, by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# The seven interlaced passes, as (first column, first row, column step, row step).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, content) up to the end chunk; a wrong checksum or a cut file is an error."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        size, name = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        content, check = raw[at + 8 : at + 8 + size], raw[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(name + content) != int.from_bytes(check, "big"):
            raise ValueError("damaged chunk")
        yield name, content
        if name == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end chunk")


def _nearest(left: int, above: int, corner: int) -> int:
    """Of three neighbours, the one nearest to left + above - corner; the first of equals."""
    a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
    return left if a <= b and a <= c else above if b <= c else corner


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from its filtered ones and the row above."""
    if kind == 0:
        return line
    if kind == 1:  # each byte adds to the one a pixel before: a running sum for each byte of a pixel
        padded = np.concatenate([line, np.zeros(-len(line) % step, np.uint8)]).reshape(-1, step)
        return np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("unknown row filter")
    out, up = bytearray(step) + bytearray(line.tobytes()), bytes(step) + above.tobytes()
    for i in range(step, len(out)):
        left = out[i - step]
        out[i] = (out[i] + ((left + up[i]) >> 1 if kind == 3 else _nearest(left, up[i], up[i - step]))) & 255
    return np.frombuffer(bytes(out[step:]), np.uint8)


def _rows(data: bytes, at: int, width: int, height: int, bits: int) -> tuple[np.ndarray, int]:
    """The rows (height, bytes) of one pass, and where the next begins."""
    size, step = (width * bits + 7) // 8, max(1, bits // 8)
    filtered = np.frombuffer(data, np.uint8, height * (size + 1), at).reshape(height, size + 1)
    out, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8)
    for k in range(height):
        above = out[k] = _unfiltered(int(filtered[k, 0]), filtered[k, 1:], above, step)
    return out, at + height * (size + 1)


def _samples(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """(height, width, samples) whole numbers of `depth` bits; of 16 the upper 8."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(len(rows), -1, depth)
        rows = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return rows[:, : width * samples].reshape(len(rows), width, samples)


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3)."""
    head, palette, packed = None, None, []
    for name, content in chunks(raw):
        if name == b"IHDR":
            head = content
        elif name == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(content)
    if head is None or len(head) != 13:
        raise ValueError("no header")
    width, height = (int.from_bytes(head[k : k + 4], "big") for k in (0, 4))
    depth, colour, interlaced = head[8], head[9], head[12]
    if not width or not height or colour not in SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unknown form")
    n, data = SAMPLES[colour], zlib.decompress(b"".join(packed))
    pixels, at = np.zeros((height, width, n), np.uint8), 0
    for x, y, right, down in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // right), -(-(height - y) // down)
        if w > 0 and h > 0:
            rows, at = _rows(data, at, w, h, depth * n)
            pixels[y::down, x::right] = _samples(rows, w, depth, n)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("colour without a palette entry")
        return palette[pixels[:, :, 0]]
    if depth < 8:
        pixels = (pixels.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (0, 4) else pixels[:, :, :3]
