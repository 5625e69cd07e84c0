"""Netpbm (P1 to P6) and PNG images as grids (y, x, channel), and back; PostScript out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.files import read_bytes


def _header(data: bytes) -> tuple[str, list[int], int]:
    """Magic number, header numbers and where the pixels start; # starts a comment."""
    at, fields, kind = 2, [], data[:2].decode("ascii", "replace")
    want = 2 if kind in ("P1", "P4") else 3
    while len(fields) < want:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header is cut off")
        fields.append(int(data[at:end]))
        at = end
    return kind, fields, at + 1


def decode_pnm(data: bytes) -> np.ndarray:
    """Pixels as (height, width, channels); a set bit is 1, black."""
    kind, fields, at = _header(data)
    width, height = fields[:2]
    channels = 3 if kind in ("P3", "P6") else 1
    n = width * height * channels
    if kind == "P1":
        flat = np.array([c - 48 for c in data[at:] if c in b"01"][:n])
    elif kind in ("P2", "P3"):
        flat = np.array(data[at:].split()[:n], dtype=int)
    elif kind == "P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        flat = bits[:, :width].ravel()
    elif kind in ("P5", "P6"):
        flat = np.frombuffer(data, np.uint8 if fields[2] < 256 else ">u2", n, at)
    else:
        raise ValueError("not a Netpbm image")
    if len(flat) < n:
        raise ValueError("the image is cut off")
    return flat.astype(float).reshape(height, width, channels)


def encode_pnm(pixels: np.ndarray) -> bytes:
    """P5 for one channel, P6 for three."""
    h, w, c = pixels.shape
    return f"P{6 if c == 3 else 5}\n{w} {h}\n255\n".encode() + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the filter of each line; ``step`` bytes make a pixel."""
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] - 1 + step), np.uint8)
    for y, line in enumerate(rows, 1):
        kind, raw, now, up = int(line[0]), line[1:], out[y], out[y - 1]
        if kind == 0:
            now[step:] = raw
        elif kind == 2:
            now[step:] = raw + up[step:]
        elif kind in (1, 3, 4):
            for x, byte in enumerate(raw.tolist(), step):
                left, above, corner = int(now[x - step]), int(up[x]), int(up[x - step])
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((left, above, corner), key=lambda c: abs(p - c))
                now[x] = (byte + guess) & 255
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of 8 bits a channel, not interlaced, as (height, width, channels): grey, grey
    and alpha, colour, colour and alpha, or a palette's colours."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += n + 12
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("a PNG of 8 bits, not interlaced, is needed")
    width, height, _, colour, *_ = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) < height * (width * channels + 1):
        raise ValueError("the image is cut off")
    pixels = _unfilter(raw[: height * (width * channels + 1)].reshape(height, -1), channels).reshape(height, width, channels)
    return (palette[pixels[:, :, 0]] if colour == 3 else pixels).astype(float)


def encode_png(pixels: np.ndarray) -> bytes:
    """One channel grey, two grey and alpha, three colour, four colour and alpha."""
    h, w, c = pixels.shape
    lines = np.zeros((h, w * c + 1), np.uint8)
    lines[:, 1:] = np.clip(pixels, 0, 255).astype(np.uint8).reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_ps(pixels: np.ndarray) -> bytes:
    """A PostScript page with the image, a point a pixel."""
    h, w, c = pixels.shape
    data = np.clip(pixels if c == 3 else np.repeat(pixels[:, :, :1], 3, axis=2), 0, 255).astype(np.uint8).tobytes().hex()
    lines = "\n".join(data[k : k + 72] for k in range(0, len(data), 72))
    return f"%!PS-Adobe-3.0\n%%BoundingBox: 0 0 {w} {h}\n{w} {h} scale\n{w} {h} 8 [{w} 0 0 {-h} 0 {h}]\n{{currentfile {3 * w} string readhexstring pop}} false 3 colorimage\n{lines}\nshowpage\n".encode()


#: Image formats: the bytes a file begins with, and its decoder.
READERS: list[tuple[bytes, Callable[[bytes], np.ndarray]]] = [(b"\x89PNG", decode_png)] + [(f"P{k}".encode(), decode_pnm) for k in range(1, 7)]
WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {"pnm": encode_pnm, "png": encode_png, "ps": encode_ps}


def register(magic: bytes, decoder: Callable[[bytes], np.ndarray]) -> None:
    """A further format; those registered last are asked first."""
    READERS.insert(0, (magic, decoder))


def decode_image(data: bytes, readers: list | None = None) -> np.ndarray:
    for magic, decoder in READERS if readers is None else readers:
        if data.startswith(magic):
            return decoder(data)
    raise ValueError("an unknown image format")


def decode_images(files: DataFrame) -> DataFrame:
    """(path, content) to path, y, x, c, v of every pixel."""
    readers = list(READERS)  # those of the driver, workers have their own

    def run(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                p = decode_image(bytes(data), readers)
                y, x, c = (i.ravel().astype(np.int32) for i in np.indices(p.shape))
                yield pd.DataFrame({"path": name, "y": y, "x": x, "c": c, "v": p.ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, y int, x int, c int, v double")


def read_images(spark: SparkSession, path: str, glob: str = "*.p?m") -> DataFrame:
    """path, y, x, c, v of every pixel of the files."""
    return decode_images(read_bytes(spark, path, glob))


def write_images(pixels: DataFrame, kind: str = "pnm") -> DataFrame:
    """path and the file's content for each image of (path, y, x, c, v); an image fits a task."""
    encode = WRITERS[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, pdf["c"].max() + 1))
        p[pdf["y"], pdf["x"], pdf["c"]] = pdf["v"]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [encode(p)]})

    return pixels.groupBy("path").applyInPandas(run, "path string, content binary")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey value of a pixel, cut to a whole number."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def jet(t: Column) -> Column:
    """Red, green and blue (0..255) of a level from 0 to 1, in four straight pieces."""
    t = F.when(F.isnan(t), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    r = F.when(t < 0.5, 0.0).when(t < 0.75, (t - 0.5) * 4).otherwise(1.0)
    g = F.when(t < 0.25, t * 4).when(t < 0.75, 1.0).otherwise((1 - t) * 4)
    b = F.when(t < 0.25, 1.0).when(t < 0.5, (0.5 - t) * 4).otherwise(0.0)
    return F.struct(*[F.floor(c * 255).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])
