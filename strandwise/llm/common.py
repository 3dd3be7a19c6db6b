"""Shared plumbing: scratch tables, code shipping, byte-level batch helpers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship, shared_root

#: Bytes of text handled at once by the numpy kernels (their temporaries are 8 to 40 times that).
CHUNK_BYTES = 1 << 20
#: Scratch tables of this session that clear_scratch() may delete: (owner, table name or None, folder).
_MADE: list[tuple[str, str | None, str]] = []
_OWNER = [""]


scratch_root = shared_root


@contextlib.contextmanager
def owned(name: str):
    """Scratch tables made inside belong to `name`, so that they can be deleted apart from all others."""
    before, _OWNER[0] = _OWNER[0], name
    try:
        yield
    finally:
        _OWNER[0] = before


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/strandwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _MADE.append((_OWNER[0], None, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        _MADE[:] = [x for x in _MADE if x[2] != path]


def clear_scratch(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the scratch tables made so far, all or those of one owner. Call it when results that read them have been written."""
    for x in [x for x in _MADE if owner is None or x[0] == owner]:
        _MADE.remove(x)
        if x[1]:
            spark.sql(f"DROP TABLE IF EXISTS {x[1]}")
        else:
            _delete(spark, x[2])
    release(spark)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (a longer text stands alone and whole)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_M = (1 << 64) - 1
_POWERS: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd); kept, and doubled when too short."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 2 * len(have[0]) if have else 0)
        inv = pow(base, -1, 1 << 64)
        tables = []
        for b in (base, inv):
            t = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                t[done : done + more] = t[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            tables.append(t)
        have = _POWERS[base] = tables
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: ASCII upper case to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

P_BYTE, P_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts raw[off[i]:off[i+1]]: (lowered bytes, starts, ends, text number, 64-bit hash)."""
    low = LOWER[raw]
    n = len(low)
    isw = np.zeros(n + 2, bool)
    isw[1:-1] = WORD[low]
    first = isw[1:-1] & ~isw[:-2]
    last = isw[1:-1] & ~isw[2:]
    cut = off[(off > 0) & (off < n)]
    first[cut] |= isw[1:-1][cut]
    last[cut - 1] |= isw[1:-1][cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, s, side="right") - 1
    pw, ipw = powers(P_BYTE, n + 1)
    cs = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[:n], out=cs[1:])
    h = mix((cs[e] - cs[s]) * ipw[s] + (e - s).astype(np.uint64))
    return low, s, e, doc, h


def windows_of(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of all runs of n words that lie in one text."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pw, ipw = powers(P_WORD, len(h) + 1)
    cs = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=cs[1:])
    at = np.flatnonzero(doc[:k] == doc[n - 1 :])
    return at, mix((cs[at + n] - cs[at]) * ipw[at])


def parts_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Shuffle partitions for a text table: the session's number, or more if its scan is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size > 1 << 56 else max(own, size // each)  # a table of unknown size is said to be endless


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write to a table in the shared warehouse, bucketed by key: later joins on key don't shuffle it again."""
    spark = df.sparkSession
    table = f"strandwise_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).saveAsTable(table, format="parquet")
    _MADE.append((_OWNER[0], table, ""))
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver next collects garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def pieces(off: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of chunks; a text longer than 8 x most comes in overlapping pieces."""
    for lo, hi in chunks(off, most):
        a, b = int(off[lo]), int(off[hi])
        if hi - lo == 1 and b - a > 8 * most:
            while b - a > 8 * most:
                yield lo, hi, a, a + 8 * most
                a += 8 * most - overlap
        yield lo, hi, a, b


_KEPT: dict = {}


def kept(key, make):
    """An object that a Python worker keeps between its tasks (a vocabulary, a model, a cache): one at a time."""
    if key not in _KEPT:
        trim()
        _KEPT[key] = make()
    return _KEPT[key]


def resident() -> int:
    """Bytes of memory that this process holds; without /proc more than any threshold."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 1 << 62


def trim(above: int = 0) -> None:
    """Give a Python worker's memory back: it lives on after its task, beside other operators' tasks.

    A worker that holds less than `above` bytes has little to give; looking takes it longer than a small task does.
    """
    import ctypes
    import gc

    if resident() < above:
        return
    _KEPT.clear()
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pack_by(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of a structured array by bucket, each bucket's rows as one binary value."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rows) else np.zeros(1, np.int64)
    for a, b in zip(cut, cut[1:], strict=False):
        yield int(bucket[a]), rows[a:b].tobytes()


def same_as_before(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: whether each row's key equals that of the row before."""
    out = np.zeros(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out
