"""Raster pictures: index table, tiles of run-compressed bit planes, palette, physical size, PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed: data items; the sixteen colours; the four-colour families, as indices of them.
IMAGE, PALETTE, TILES, PRINT, FIRST_TILE = 0x00, 0x01, 0x02, 0x11, 0x8000
COLOURS = ["000000", "0000aa", "00aa00", "00aaaa", "aa0000", "aa00aa", "aa5500", "aaaaaa", "555555", "5555ff", "55ff55", "55ffff", "ff5555", "ff55ff", "ffff55", "ffffff"]
FAMILIES = [(0, 2, 4, 6), (0, 10, 12, 14), (0, 3, 5, 7), (0, 11, 13, 15), (0, 3, 4, 7), (0, 11, 12, 15)]
RGB = np.array([tuple(bytes.fromhex(c)) for c in COLOURS], dtype=np.uint8)


class PictureError(ValueError):
    pass


class TextPicture(PictureError):
    """A capture of characters, not of pixels."""


def items_of(data: bytes) -> dict[int, bytes]:
    if len(data) < 4:
        raise PictureError("too short for a header")
    n = struct.unpack_from("<H", data, 2)[0]
    if len(data) < 4 + 8 * n:
        raise PictureError("the index table is cut off")
    return {k: data[at : at + size] for k, size, at in struct.iter_unpack("<HHI", data[4 : 4 + 8 * n])}


def _item(items: dict[int, bytes], key: int, least: int, what: str) -> bytes:
    if len(items.get(key, b"")) < least:
        raise PictureError(f"{what} is missing or too short")
    return items[key]


def plane(data: bytes, at: int, n_rows: int, width: int) -> tuple[np.ndarray, int]:
    """Rows of bytes: the first in full, each later one as a mask of changed bytes and their new values. What is cut
    off stays zero."""
    out = np.zeros((n_rows, width), dtype=np.uint8)
    mask_bytes = -(-width // 8)
    for k in range(n_rows):
        if k == 0:
            if at + width > len(data):
                break
            out[0] = np.frombuffer(data, np.uint8, width, at)
            at += width
            continue
        if at + mask_bytes > len(data):
            break
        changed = np.unpackbits(np.frombuffer(data, np.uint8, mask_bytes, at))[:width].astype(bool)
        at += mask_bytes
        n = int(changed.sum())
        if at + n > len(data):
            at = len(data)
            break
        out[k] = out[k - 1]
        out[k, changed] = np.frombuffer(data, np.uint8, n, at)
        at += n
    return out, at


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Palette index of each pixel, and the palette."""
    items = items_of(data)
    info = _item(items, IMAGE, 29, "image data")
    if not info[1] & 1:
        raise TextPicture("a capture of characters")
    columns, rows, planes = *struct.unpack_from("<HH", info, 18), info[22]
    tile_rows, tile_columns, down, across = struct.unpack_from("<HHHH", _item(items, TILES, 8, "tile data"))
    width = tile_columns // 8
    if 0 in (columns, rows, planes, tile_rows, width, down, across):
        raise PictureError("no size")
    if max(down * tile_rows, across * tile_columns) > 1 << 16 or planes > 8:
        raise PictureError("no plausible size")
    image = np.zeros((down * tile_rows, across * tile_columns), dtype=np.uint8)
    for k in range(down * across):
        y, x = divmod(k, across)
        held, at = _item(items, FIRST_TILE + k, 0, f"tile {k}") if FIRST_TILE + k in items else _item({}, 0, 1, f"tile {k}"), 0
        there = max(0, min(tile_rows, rows - y * tile_rows))
        for p in range(planes):
            bits, at = plane(held, at, there, width)
            image[y * tile_rows : y * tile_rows + there, x * tile_columns : x * tile_columns + 8 * width] |= np.unpackbits(bits, axis=1) << p
    return image[:rows, :columns], palette(items.get(PALETTE, bytes(64)), planes)


def palette(raw: bytes, planes: int) -> np.ndarray:
    """Up to four colours by their bits, where entries that coincide are repaired to the one family that holds them;
    more by two bits a channel."""
    entries = np.frombuffer(raw[:64].ljust(64, b"\0"), np.uint8).reshape(16, 4)
    if planes == 1:
        return np.array([[255, 255, 255], [0, 0, 0]], dtype=np.uint8)
    if planes == 2:
        codes = ((entries[:4] & 1) * np.array([8, 4, 2, 1])).sum(axis=1)
        if len(set(codes.tolist())) < 4:
            fits = [f for f in FAMILIES if set(codes.tolist()) <= set(f)]
            codes = np.array(fits[0] if len(fits) == 1 else FAMILIES[0])
        return RGB[codes]
    channels = entries[:, 1:].astype(int)
    return np.minimum(255, 170 * (channels & 1) + 85 * (channels >> 1 & 1)).astype(np.uint8)


def physical_size(data: bytes) -> tuple[float, float] | None:
    """Width and height in inches as the print options say, if they are plausible."""
    options = items_of(data).get(PRINT, b"")
    if len(options) < 30:
        return None
    rows, columns = (x / 720 for x in struct.unpack_from("<hh", options, 24))
    return (columns, rows) if 0 < columns <= 100 and 0 < rows <= 100 else None


def png(image: np.ndarray, colours: np.ndarray) -> bytes:
    """One-bit grey for two colours in black and white, else eight-bit RGB."""
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    mono = len(colours) == 2
    rows = np.packbits(image == 0, axis=1) if mono else colours[image].reshape(len(image), -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 1 if mono else 8, 0 if mono else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_pictures(pictures: DataFrame) -> DataFrame:
    """``doc_id, path, width, height, png, error`` for ``doc_id, path, content``; never fails on a picture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, path, content in zip(batch["doc_id"], batch["path"], batch["content"], strict=True):
                try:
                    image, colours = decode(bytes(content))
                    out.append((i, path, image.shape[1], image.shape[0], png(image, colours), None))
                except TextPicture:
                    out.append((i, path, None, None, None, "text-mode"))
                except (PictureError, struct.error, IndexError, TypeError):
                    out.append((i, path, None, None, None, "format" if content is not None else "missing"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "width", "height", "png", "error"]).astype({"width": "Int32", "height": "Int32"})

    return pictures.select("doc_id", "path", "content").mapInPandas(run, "doc_id long, path string, width int, height int, png binary, error string")
