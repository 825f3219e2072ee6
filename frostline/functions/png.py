"""PNG pictures of 8-bit grey or RGB pixels, in plain Python."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Signature, chunk names, colour types by channels and filter numbers of the format (fixed values).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 3: 2}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(pixels: bytes, width: int, height: int) -> bytes:
    """A picture of width x height pixels, of one byte each (grey) or three (RGB), row by row."""
    channels = len(pixels) // max(1, width * height)
    if channels not in COLOUR or len(pixels) != width * height * channels:
        raise ValueError(f"{len(pixels)} bytes are no picture of {width} x {height}")
    rows = np.frombuffer(pixels, np.uint8).reshape(height, width * channels)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()  # each row after its filter, none
    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of a picture of 8-bit grey or RGB that isn't interlaced; others are an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG picture")
    at, head, body = 8, b"", []
    while at < len(data):
        (size,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        content, (check,) = data[at + 8 : at + 8 + size], struct.unpack(">I", data[at + 8 + size : at + 12 + size])
        if zlib.crc32(name + content) != check:
            raise ValueError("a chunk's checksum is wrong")
        head = content if name == b"IHDR" else head
        body += [content] if name == b"IDAT" else []
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {c: n for n, c in COLOUR.items()}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit grey and RGB are read")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * channels + 1)
    return width, height, _unfiltered(rows[:, 0], rows[:, 1:], channels).tobytes()


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, channels: int) -> np.ndarray:
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        if kind == SUB:
            row = np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == UP:
            row = row + above
        elif kind in (AVERAGE, PAETH):
            row = _by_neighbours(kind, row.tolist(), above.tolist(), channels)
        out[y] = above = row
    return out


def _by_neighbours(kind: int, row: list[int], above: list[int], channels: int) -> np.ndarray:
    done = [0] * channels + row
    for i, up in enumerate(above):
        left, corner = done[i], above[i - channels] if i >= channels else 0
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
            guess = (left, up, corner)[far.index(min(far))]
        done[i + channels] = (row[i] + guess) & 255
    return np.array(done[channels:], np.uint8)

