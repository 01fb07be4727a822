"""Image conversion: one pass over images after their native plan.

PNG is read and written here with zlib and numpy. Spark's image source reads JPEG, GIF, BMP, TIFF and every kind of PNG: readable() takes its rows.
To write other formats needs codecs that are not installed: a caller who has one hands it to converted(), else they become rows with an error,
as do corrupt images: a bad image never fails a task. Alpha is laid over white for formats without it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import images

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels as height x width x channels of a PNG with 8 bits a sample and without interlacing."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, palette, clear = 8, b"", None, None
    header = None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if header is None or header[2] != 8 or header[6]:
        raise ValueError("unsupported PNG")
    width, height, _, color = header[:4]
    if width * height > rules.MOST_PIXELS:
        raise ValueError("too many pixels")
    n = _CHANNELS[color]
    lines = np.frombuffer(zlib.decompressobj().decompress(data, height * (1 + width * n) or 1), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.int64)
    for y, line in enumerate(lines):
        out[y] = _unfiltered(line[0], line[1:].astype(np.int64), above, n)
        above = out[y].astype(np.int64)
    pixels = out.reshape(height, width, n)
    if color == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        table = palette if clear is None else np.concatenate([palette, alpha[:, None]], 1)
        pixels = table[pixels[:, :, 0]]
    return pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    if kind == 1:
        return (np.cumsum(line.reshape(-1, n), 0) % 256).reshape(-1)
    out = line.copy()
    for x in range(len(line)):  # each sample needs the one before it
        left, corner = (out[x - n], above[x - n]) if x >= n else (0, 0)
        if kind == 3:
            guess = (left + above[x]) // 2
        else:
            p = left + above[x] - corner
            a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
            guess = left if a <= b and a <= c else above[x] if b <= c else corner
        out[x] = (line[x] + guess) % 256
    return out


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    height, width, n = pixels.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], 1).tobytes()
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def readable(images: DataFrame) -> DataFrame:
    """filename and content for converted(), as PNG, of the rows of Spark's image source (read.format("image"), without dropInvalid), whatever their format.

    Where the source could not read an image, content is empty, and so becomes a row with an error. The source decodes an image whole, in the JVM.
    """
    flat = images.select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            contents = []
            for r in part.itertuples():
                if r.height > 0:
                    n = r.nChannels
                    order = [2, 1, 0, 3][:n] if n > 1 else [0]  # the source gives blue first
                    contents.append(encode_png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, n)[:, :, order], 1))
                else:
                    contents.append(b"")
            yield pd.DataFrame({"filename": part["filename"], "content": contents})

    return flat.mapInPandas(run, "filename string, content binary")


def over_white(pixels: np.ndarray) -> np.ndarray:
    """Colours laid over white by their alpha, truncated; images without alpha as they are."""
    if pixels.shape[2] not in (2, 4):
        return pixels
    alpha = pixels[:, :, -1:] / 255.0
    return (pixels[:, :, :-1] * alpha + 255 * (1 - alpha)).astype(np.uint8)


def _weights(old: int, new: int, how: str) -> np.ndarray:
    """Rows of weights of old places for each new one."""
    if how == "area":
        low, high = np.arange(new)[:, None] * old / new, (np.arange(new)[:, None] + 1) * old / new
        w = np.clip(np.minimum(high, np.arange(old) + 1) - np.maximum(low, np.arange(old)), 0, None)
    else:
        d = (np.arange(new)[:, None] + 0.5) * old / new - 0.5 - np.arange(old)
        w = np.where(np.abs(d) < 4, np.sinc(d) * np.sinc(d / 4), 0)
    return w / w.sum(1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area means where a side shrinks, else Lanczos over eight places."""
    if width < 1 or height < 1:
        raise ValueError("empty image")
    if (height, width) == pixels.shape[:2]:
        return pixels
    how = "area" if width < pixels.shape[1] or height < pixels.shape[0] else "lanczos4"
    out = np.einsum("yh,hwc->ywc", _weights(pixels.shape[0], height, how), pixels.astype(float))
    out = np.einsum("xw,ywc->yxc", _weights(pixels.shape[1], width, how), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Codec:
    """How a format is told by its first bytes, read to height x width x channels, and written at a quality on its own scale."""

    magic: bytes
    decode: Callable[[bytes], np.ndarray]
    encode: Callable[[np.ndarray, int], bytes]
    alpha: bool = True


CODECS = {"PNG": Codec(_MAGIC, decode_png, encode_png)}


def converted(files: DataFrame, fmt: str, quality: int | None = None, width: int | None = None, height: int | None = None, codecs: dict[str, Codec] | None = None) -> DataFrame:
    """filename, name, content, width, height and error of each image of files (filename, content).

    `codecs` by canonical format name stand beside the library's own, or in their place; they travel to the tasks with the plan.
    """
    known = CODECS | (codecs or {})
    planned = files.select(
        "filename", "content", images.canonical_format(F.lit(fmt)).alias("fmt"), images.output_name(F.col("filename"), F.lit(fmt)).alias("name"),
        F.coalesce(images.mapped_quality(images.canonical_format(F.lit(fmt)), F.lit(quality).cast("int")).cast("int"), F.lit(6)).alias("level"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                content, w, h, error = None, None, None, None
                try:
                    if r.fmt not in known:
                        raise ValueError(f"unsupported format: {r.fmt}")
                    raw, target = bytes(r.content), known[r.fmt]
                    source = next((c for c in known.values() if raw.startswith(c.magic)), None)
                    if source is None:
                        raise ValueError("unsupported image")
                    pixels = source.decode(raw) if target.alpha else over_white(source.decode(raw))
                    oh, ow = pixels.shape[:2]
                    pixels = resize(pixels, width or (int(height * (ow / oh)) if height else ow), height or (int(width / (ow / oh)) if width else oh))
                    h, w = pixels.shape[:2]
                    content = target.encode(pixels, int(r.level))
                except Exception as e:  # noqa: BLE001  one bad image is one row with its error
                    error = f"{type(e).__name__}: {e}"
                rows.append((r.filename, r.name, content, w, h, error))
            yield pd.DataFrame(rows, columns=["filename", "name", "content", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    return planned.mapInPandas(run, "filename string, name string, content binary, width int, height int, error string")
