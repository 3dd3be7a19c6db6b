"""Embedded tracks: texts and covers through encoders that the caller brings; an offline encoder is the default."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import ship

# Side of a cover, and mean and deviation of the channels that image encoders expect.
SIDE, MEAN, STD = 518, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Encoder(Protocol):
    """Maps a list of texts (or of images, as float arrays 3 x side x side) to one vector each."""

    def encode(self, items: list) -> np.ndarray: ...


class HashingEncoder:
    """Words and their neighbours, hashed into signed places: needs no model and gives the same vectors everywhere."""

    def __init__(self, size: int = 256):
        self.size = size

    def encode(self, items: list[str]) -> np.ndarray:
        out = np.zeros((len(items), self.size), np.float32)
        for row, text in zip(out, items, strict=True):
            words = text.lower().split()
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(w.encode())
                row[h % self.size] += 1 if h & 1 << 30 else -1
        return out


class PixelEncoder:
    """Means of a grid of cells of an image: a stand-in for a vision model."""

    def __init__(self, cells: int = 4):
        self.cells = cells

    def encode(self, items: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.stack([b.mean(axis=(1, 2)) for a in np.array_split(x, self.cells, 1) for b in np.array_split(a, self.cells, 2)]).ravel() for x in items])


def unit_rows(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), least)).astype(np.float32)


_MADE: dict = {}


def _encoder(key: str, factory: Callable[[], Encoder]) -> Encoder:
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = factory()
    return _MADE[key]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), pa.float32()))


def semantic_text(books: DataFrame, joiner: str = "\n"):
    """Title and description as one text, case and punctuation kept."""
    return F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(joiner), F.coalesce("description", F.lit(""))))


def embed_texts(books: DataFrame, factory: Callable[[], Encoder] = HashingEncoder, batch: int = 64, unit: bool = True, joiner: str = "\n") -> DataFrame:
    """(book_id, v): one vector per row. The encoder is made once per worker; rows pass in batches of `batch`."""
    ship(books.sparkSession)
    key = f"{getattr(factory, '__name__', 'encoder')}-{id(factory)}"

    def run(batches):
        enc = _encoder(key, factory)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                v = np.asarray(enc.encode(part.column("text").to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([part.column("book_id"), _lists(unit_rows(v) if unit else v)], ["book_id", "v"])

    return books.select("book_id", semantic_text(books, joiner).alias("text")).mapInArrow(run, "book_id long, v array<float>")


def resize_weights(size: int, to: int) -> np.ndarray:
    """Triangle filter (to x size) of a bilinear resize that averages when it shrinks."""
    scale = size / to
    reach = max(scale, 1.0)
    at = (np.arange(to)[:, None] + 0.5) * scale
    w = np.maximum(0, 1 - np.abs(np.arange(size)[None, :] + 0.5 - at) / reach)
    return w / w.sum(axis=1, keepdims=True)


def letterbox(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A picture (height x width x 3, bytes) centred on a black square, resized and normalised, channels first."""
    h, w = image.shape[:2]
    n = max(h, w)
    top, left = (n - h) // 2, (n - w) // 2
    square = np.zeros((n, n, 3))
    square[top : top + h, left : left + w] = image
    m = resize_weights(n, side)
    small = np.stack([m @ square[..., c] @ m.T for c in range(3)])
    return ((np.clip(np.round(small), 0, 255) / 255 - np.array(MEAN)[:, None, None]) / np.array(STD)[:, None, None]).astype(np.float32)


def read_ppm(data: bytes) -> np.ndarray | None:
    """A picture in the plain binary PPM form (P6); None if it can't be read. Other forms need a decoder of the caller's."""
    parts = data.split(None, 4) if data[:2] == b"P6" else []
    if len(parts) < 5 or not all(p.isdigit() for p in parts[1:4]) or len(parts[4]) < 3 * int(parts[1]) * int(parts[2]):
        return None
    w, h = int(parts[1]), int(parts[2])
    return np.frombuffer(parts[4][: 3 * w * h], np.uint8).reshape(h, w, 3)


def covers(books: DataFrame, fetch: Callable[[str], bytes | None], cache: DataFrame | None = None) -> DataFrame:
    """(book_id, key, data, placeholder): cover bytes by the MD5 of their address, from the cache or else fetched.

    Placeholder addresses are never fetched (an empty address is no placeholder of the site's); what fails is null.
    """
    rows = books.select("book_id", "image_url", F.md5(F.coalesce("image_url", F.lit(""))).alias("key"), T.placeholder_url(F.col("image_url")).alias("skip"))
    rows = rows.withColumn("placeholder", F.col("skip") & (F.coalesce("image_url", F.lit("")) != ""))
    cached = cache if cache is not None else books.sparkSession.createDataFrame([], "key string, data binary")
    rows = rows.join(cached.dropDuplicates(["key"]), "key", "left")

    def run(batches):
        for b in batches:
            got = []
            for url, skip, data in zip(*(b.column(c).to_pylist() for c in ("image_url", "skip", "data")), strict=True):
                if data is None and not skip:
                    try:
                        data = fetch(url)
                    except Exception:  # a cover that can't be had is no cover
                        data = None
                got.append(data)
            yield pa.RecordBatch.from_arrays([b.column("book_id"), b.column("key"), pa.array(got, pa.binary()), b.column("placeholder")], ["book_id", "key", "data", "placeholder"])

    return rows.select("book_id", "image_url", "key", "skip", "data", "placeholder").mapInArrow(run, "book_id long, key string, data binary, placeholder boolean")


def cover_folder(spark, path: str) -> DataFrame:
    """(key, data) of a folder of files that are named by the MD5 of their address."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([0-9a-f]{32})\.\w+$", 1).alias("key"), F.col("content").alias("data")).where("key <> ''")


def embed_covers(found: DataFrame, factory: Callable[[], Encoder] = PixelEncoder, decode: Callable[[bytes], np.ndarray | None] = read_ppm, side: int = SIDE, batch: int = 32) -> DataFrame:
    """(book_id, v): a vector for each cover that can be read, null without one."""
    ship(found.sparkSession)
    key = f"{getattr(factory, '__name__', 'encoder')}-{id(factory)}-{side}"

    def run(batches):
        enc = _encoder(key, factory)
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                images = [None if d is None else decode(d) for d in part.column("data").to_pylist()]
                v: list = [None] * len(images)
                some = [i for i, x in enumerate(images) if x is not None]
                if some:
                    for i, row in zip(some, unit_rows(np.asarray(enc.encode([letterbox(images[i], side) for i in some]))), strict=True):
                        v[i] = row
                yield pa.RecordBatch.from_arrays([part.column("book_id"), pa.array(v, pa.list_(pa.float32()))], ["book_id", "v"])

    return found.select("book_id", "data").mapInArrow(run, "book_id long, v array<float>")
