"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by token windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, ship, trim, windows_of, words_of

#: Bytes of benchmark text in one hash set, which takes about five times that; a larger benchmark is scanned in several passes.
SET_BYTES = 16 << 20
_FILTER_BITS = 22
#: Windows whose items a task keeps looked up.
_KEPT = 20_000


class WindowSet:
    """Hash set of the windows of benchmark items, in flat arrays.

    By window length: sorted hashes, each with its item and the span of its words in one buffer, in which the items'
    normalised words are joined by a space. So a window costs 24 bytes beside the words, and a hit is verified by
    comparing bytes.
    """

    def __init__(self, items: list[tuple[object, str]], width: int):
        self.names = [None if i is None else str(i) for i, _ in items]
        raw, off = buffers(pa.array([t or "" for _, t in items], pa.string()))
        words, found, base = [], {}, 0
        for lo, hi in chunks(off):
            low, s, e, doc, h = words_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            size = e - s
            at = np.cumsum(size + 1) - size - 1
            text = np.full(int((size + 1).sum()), 32, np.uint8)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text[np.repeat(at, size) + inner] = low[np.repeat(s, size) + inner]
            per = np.bincount(doc, minlength=hi - lo)
            for n in {min(width, int(c)) for c in per if c}:
                first, keys = windows_of(h, doc, n)
                keep = per[doc[first]] >= width if n == width else per[doc[first]] == n
                first, keys = first[keep], keys[keep]
                last = first + n - 1
                found.setdefault(n, []).append((keys, base + at[first], (at[last] + size[last] - at[first]).astype(np.int32), (lo + doc[first]).astype(np.int32)))
            words.append(text)
            base += len(text)
        self.text = np.concatenate(words) if words else np.zeros(0, np.uint8)
        self.by_width = {}
        for n, rows in found.items():
            keys, at, size, item = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_width[n] = (keys[order], maybe, at[order], size[order], item[order])

    def nbytes(self) -> int:
        """Bytes of all arrays."""
        return self.text.nbytes + sum(a.nbytes for t in self.by_width.values() for a in t)

    def items_of(self, n: int, key: int) -> dict[bytes, set[str]]:
        """The windows of a hash, as joined words, with the ids of the items that have them."""
        keys, _, at, size, item = self.by_width[n]
        out: dict[bytes, set[str]] = {}
        for k in range(int(np.searchsorted(keys, np.uint64(key))), int(np.searchsorted(keys, np.uint64(key), side="right"))):
            ids = out.setdefault(self.text[at[k] : at[k] + size[k]].tobytes(), set())
            if self.names[item[k]] is not None:
                ids.add(self.names[item[k]])
        return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(batches, sets, carry):
    """Adds to each row the word and byte spans hit and the items found."""
    trim()
    sets = sets.value
    known: dict = {}
    for batch in batches:
        raw, off = buffers(batch.column("text"))
        n = batch.num_rows
        n_words = np.zeros(n, np.int64)
        hits: dict[int, tuple[list, list, set]] = {}
        for lo, hi in chunks(off):
            low, s, e, doc, h = words_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n_words[lo:hi] = np.bincount(doc, minlength=hi - lo)
            first = np.zeros(hi - lo + 1, np.int64)
            np.cumsum(n_words[lo:hi], out=first[1:])
            base = off[lo:hi] - off[lo]
            for width, (keys, likely, *_) in sets.by_width.items():
                at, win = windows_of(h, doc, width)
                maybe = np.flatnonzero(likely[(win >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                where = np.minimum(np.searchsorted(keys, win[maybe]), len(keys) - 1)
                maybe = maybe[keys[where] == win[maybe]]
                for i, k in zip(at[maybe].tolist(), win[maybe].tolist(), strict=True):
                    if (width, k) not in known:
                        if len(known) >= _KEPT:
                            known.clear()
                        known[width, k] = sets.items_of(width, k)
                    ids = known[width, k].get(b" ".join([low[a:b].tobytes() for a, b in zip(s[i : i + width].tolist(), e[i : i + width].tolist(), strict=True)]))
                    if ids is None:
                        continue  # equal hash, other words
                    d = int(doc[i])
                    words, spans, items = hits.setdefault(lo + d, ([], [], set()))
                    words.append((i - int(first[d]), i - int(first[d]) + width))
                    spans.append((int(s[i] - base[d]), int(e[i + width - 1] - base[d])))
                    items.update(ids)
        w_col, b_col, i_col = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
        if carry:
            w_col, b_col, i_col = (batch.column(c).to_pylist() for c in ("word_spans", "byte_spans", "items"))
        for r, (words, spans, items) in hits.items():
            w_col[r] = [x for p in _merge(words + list(zip(w_col[r][::2], w_col[r][1::2], strict=True))) for x in p]
            b_col[r] = [x for p in _merge(spans + list(zip(b_col[r][::2], b_col[r][1::2], strict=True))) for x in p]
            i_col[r] = sorted({*items, *i_col[r]})
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("text"), pa.array(n_words), pa.array(w_col, pa.list_(pa.int64())), pa.array(b_col, pa.list_(pa.int64())), pa.array(i_col, pa.list_(pa.string()))],
            ["rid", "text", "n_words", "word_spans", "byte_spans", "items"],
        )


def benchmark_slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", set_bytes: int = SET_BYTES):
    """The benchmark in lists of rows of at most set_bytes bytes each (a single longer item stands alone)."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // set_bytes) + 1
    if n == 1:
        yield [(r[0], r[1]) for r in items.collect()]
        return
    for k in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """Per row: rid, text, n_words, word_spans and byte_spans (flat start, end, start, end ...), items.

    Words are runs of digits, letters and non-ASCII characters, ASCII lower-cased. A window is `width`
    consecutive words of an item, or all of a shorter item. Window hashes are looked up in a broadcast
    hash set, and each hit is verified word by word, so a hash collision never counts. The set's size is
    bounded: a benchmark of more than set_bytes of text is scanned in several passes, each with its own set. No
    shuffle: rows stay where they were read.

    Null or empty texts have no words and no hits; null item texts are ignored; an item with a null id
    hits but names no item; equal items both count; an empty table gives an empty result; other columns
    are dropped (join on rid).
    """
    spark = docs.sparkSession
    ship(spark)
    idt = dict(docs.select(F.col(id_col).alias("rid")).dtypes)["rid"]
    out = docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"rid {idt}, text string, n_words long, word_spans array<long>, byte_spans array<long>, items array<string>"
    for k, rows in enumerate(benchmark_slices(benchmark, set_bytes=set_bytes)):
        sets = spark.sparkContext.broadcast(WindowSet(rows, width))
        out = out.mapInArrow(lambda it, sets=sets, carry=bool(k): _scan(it, sets, carry), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Digest of find_hits per document (the contract of op8)."""
    hits = find_hits(docs, benchmark, width)
    n_hit = F.expr("aggregate(sequence(0L, size(word_spans) div 2L), 0L, (a, i) -> a + if(i * 2 < size(word_spans), word_spans[int(i * 2 + 1)] - word_spans[int(i * 2)], 0L))")
    return hits.select(
        F.col("rid").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def _cut(batches):
    for batch in batches:
        texts = [bytearray(t.encode()) for t in batch.column("text").to_pylist()]
        for t, spans in zip(texts, batch.column("byte_spans").to_pylist(), strict=True):
            for a, b in reversed(list(zip(spans[::2], spans[1::2], strict=True))):
                del t[a:b]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([bytes(t).decode() for t in texts], pa.string())], ["rid", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every row, with the words of each hit and what stands between them cut out.

    A null text becomes an empty one; texts without a hit stay as they are; repeated rows are each cut; an empty table
    gives an empty result; other columns are dropped.
    """
    hits = find_hits(docs, benchmark, width, id_col, text_col).select("rid", "text", "byte_spans")
    rid = hits.schema["rid"].dataType.simpleString()
    return hits.mapInArrow(_cut, f"rid {rid}, text string").select(F.col("rid").alias(id_col), F.col("text").alias(text_col))


def _drop(batches, sets):
    trim()
    for batch in batches:
        n = batch.num_rows
        probe = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), batch.column("text")], ["rid", "text"])
        keep = [not s for out in _scan([probe], sets, False) for s in out.column("word_spans").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, set_bytes: int = SET_BYTES) -> DataFrame:
    """All columns of the rows that have no hit, in place: no join and no shuffle. docs has a column `text`.

    Null and empty texts have no hit and stay; repeated rows are each judged; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    out = docs
    for rows in benchmark_slices(benchmark, set_bytes=set_bytes):
        sets = spark.sparkContext.broadcast(WindowSet(rows, width))
        out = out.mapInArrow(lambda it, sets=sets: _drop(it, sets), docs.schema)
    return out
