"""Removal of repeated byte strings: suffixes ordered through `depth` bytes by most-significant-digit passes.

A plain suffix array would order every suffix. Here only suffixes that can take part in a repeat are ordered:
each window of `depth` bytes is represented by the leftmost smallest hash among its 51-byte strings (its anchor),
which equal windows share. The steps, each a narrow shuffle of fixed-size records:

1. anchors whose string occurs once are dropped (each task sends each string once, with one place);
2. the windows of one anchor form a context; equal contexts are found by 128-bit hashes, and all but the first
   occurrence are repeated as a whole;
3. first occurrences of different contexts around equal anchors are compared window by window: a radix sort by
   8-byte digits, most significant first, drops suffixes that stand alone after each pass and stops at `depth`
   bytes. Groups left are exactly the repeated windows. Anchors with very many contexts (a line in a third of all
   documents) take window hashes instead, which tasks combine before they send them.

Texts are shuffled once, into a table bucketed by document; places, not texts, move afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P_BYTE, bucketed, buffers, drop_scratch, mix, pack_by, parts_for, pieces, powers, release, same_as_before, scratch, ship, trim

ANCHOR = 51
#: Contexts of one anchor string up to which they are compared in one task; beyond, window hashes are exchanged.
WIDE = 256
_P2 = 0xA0761D6478BD642F
_BITS = 24
_FLUSH = 600_000
#: Rows that share an id are told apart by the high bits of a position.
_ROW_SHIFT = 40

_A = np.dtype([("h", "<u8"), ("id", "<i8"), ("pos", "<i8"), ("flag", "u1")])
_C = np.dtype([("c1", "<u8"), ("c2", "<u8"), ("h", "<u8"), ("id", "<i8"), ("s", "<i8"), ("n", "<i4"), ("rel", "<i4")])
_X = np.dtype([("h", "<u8"), ("id", "<i8"), ("s", "<i8"), ("n", "<i4"), ("rel", "<i4")])
_W = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("id", "<i8"), ("s", "<i8")])


class Chunk:
    """Hashes of a chunk of texts and the runs of windows that share an anchor."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, depth: int):
        self.raw, self.off, self.depth = raw, off, depth
        n, wide = len(raw), depth - ANCHOR + 1
        self.anchor = self.first = self.last = np.zeros(0, np.int64)
        if n < depth:
            return
        self.p1, self.ip1 = powers(P_BYTE, n + 1)
        self.v = raw.astype(np.uint64) + np.uint64(1)
        cs = np.zeros(n + 1, np.uint64)
        np.cumsum(self.v * self.p1[:n], out=cs[1:])
        self.cs1, self.cs2 = cs, None
        m = n - ANCHOR + 1
        h = mix((cs[ANCHOR:] - cs[:m]) * self.ip1[:m])
        low = np.uint64((1 << _BITS) - 1)
        key = (h & ~low) | np.arange(m, dtype=np.uint64)
        step = 1
        while step * 2 <= wide:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if step < wide:
            key = np.minimum(key[: len(key) - (wide - step)], key[wide - step :])
        at = (key & low).astype(np.int64)
        w = len(at)
        open_ = np.zeros(w + 2, np.int32)
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        np.add.at(open_, np.clip(cut - depth + 1, 0, w), 1)
        np.add.at(open_, np.clip(cut, 0, w), -1)
        valid = np.zeros(w + 2, bool)
        valid[1:-1] = np.cumsum(open_[:w]) == 0
        new, end = np.ones(w, bool), np.ones(w, bool)
        new[1:] = at[1:] != at[:-1]
        end[:-1] = new[1:]
        ok = valid[1:-1]
        self.first = np.flatnonzero(ok & (new | ~valid[:-2]))
        self.last = np.flatnonzero(ok & (end | ~valid[2:]))
        self.anchor = at[self.first]
        self.h = h[self.anchor]
        self.doc = np.searchsorted(off, self.first, side="right") - 1

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of raw[a:b]."""
        if self.cs2 is None:
            n = len(self.raw)
            self.p2, self.ip2 = powers(_P2, n + 1)
            self.cs2 = np.zeros(n + 1, np.uint64)
            np.cumsum(self.v * self.p2[:n], out=self.cs2[1:])
        size = (b - a).astype(np.uint64)
        return mix((self.cs1[b] - self.cs1[a]) * self.ip1[a] + size), mix((self.cs2[b] - self.cs2[a]) * self.ip2[a] + size)


def _chunks_of(batch, depth, most=1 << 20):
    """(chunk, its rows' ids, its texts' starts as positions) of a batch with id, j and text."""
    raw, off = buffers(batch.column("text"))
    ids = batch.column("id").to_numpy()
    base = batch.column("j").to_numpy().astype(np.int64) << _ROW_SHIFT
    for lo, hi, a, b in pieces(off, most, depth - 1):
        inside = np.clip(off[lo : hi + 1], a, b) - a
        # A position within a text is what is added to the row's base; a piece of a long text starts later.
        start = base[lo:hi] + np.where(off[lo:hi] < a, a - off[lo:hi], 0) - inside[:-1]
        yield Chunk(raw[a:b], inside, depth), ids[lo:hi], start, lo, hi


def _blobs(rows):
    out = list(rows)
    if out:
        bucket, kind, data = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.large_binary() if sum(map(len, data)) > 1 << 30 else pa.binary())], ["bucket", "kind", "data"])


def _gather(batches, kinds):
    got = {k: [] for k in kinds}
    for b in batches:
        for k, d in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
            got[k].append(d)
    return {k: np.frombuffer(b"".join(got[k]), t) if t is not None else got[k] for k, t in kinds.items()}


def _anchors(batches, depth, n):
    trim()
    held, size = [], 0

    def flush():
        x = np.concatenate(held)
        x = x[np.lexsort((x["pos"], x["id"], x["h"]))]
        again = same_as_before(x["h"])
        one, more = x[~again].copy(), x[again].copy()
        one["flag"][:-1] = again[np.flatnonzero(~again)[1:] - 1]
        if len(one):
            one["flag"][-1] = again[-1]
        more["flag"] = 2
        for rows, by in ((one, one["h"]), (more, mix(more["id"].astype(np.uint64)))):
            for k, d in pack_by(((by >> np.uint64(20)) % np.uint64(n)).astype(np.int64), rows):
                yield k, 0, d

    for batch in batches:
        for c, ids, start, _, _ in _chunks_of(batch, depth):
            if len(c.anchor):
                x = np.zeros(len(c.anchor), _A)
                x["h"], x["id"], x["pos"] = c.h, ids[c.doc], c.anchor + start[c.doc]
                held.append(x)
                size += len(x)
        if size > _FLUSH:
            yield from _blobs(flush())
            held, size = [], 0
    if held:
        yield from _blobs(flush())


def _repeated(batches):
    x = _gather(batches, {0: _A})[0]
    known, x = x[x["flag"] == 2], x[x["flag"] != 2]
    x = x[np.argsort(x["h"], kind="stable")]
    again = same_as_before(x["h"])
    keep = again | (x["flag"] == 1)
    keep[:-1] |= again[1:]
    # A string that one task saw twice is repeated wherever else it stands; equal neighbours cover that.
    x = np.concatenate([x[keep], known])
    for lo in range(0, len(x), 200_000):
        y = x[lo : lo + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(y["id"].copy()), pa.array(y["pos"].copy())], ["id", "pos"])


def _lists(batch, name):
    col = batch.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col


def _contexts(batches, depth, n):
    trim()
    held, size = [], 0

    def flush():
        x = np.concatenate(held)
        x = x[np.lexsort((x["s"], x["id"], x["c2"], x["c1"]))]
        again = same_as_before(x["c1"], x["c2"])
        for kind, rows, by in ((0, x[~again], x["c1"][~again]), (1, x[again], mix(x["id"][again].astype(np.uint64)))):
            for k, d in pack_by(((by >> np.uint64(20)) % np.uint64(n)).astype(np.int64), rows):
                yield k, kind, d

    for batch in batches:
        places = _lists(batch, "places")
        flat = places.flatten().to_numpy()
        counts = np.diff(places.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), counts)
        for c, ids, start, lo, hi in _chunks_of(batch, depth):
            if not len(c.anchor):
                continue
            a, b = np.searchsorted(row, [lo, hi])
            want = flat[a:b] - start[row[a:b] - lo]
            # Places of other rows with the same id, or of other pieces, fall outside this text's bytes.
            want = want[(want >= c.off[row[a:b] - lo]) & (want < c.off[row[a:b] - lo + 1])]
            keep = np.isin(c.anchor, want)
            if not keep.any():
                continue
            s, e = c.first[keep], c.last[keep] + depth
            x = np.zeros(len(s), _C)
            c1, c2 = c.hashes(s, e)
            rel = c.anchor[keep] - s
            x["c1"], x["c2"], x["h"], x["id"] = c1 ^ mix(rel.astype(np.uint64)), c2, c.h[keep], ids[c.doc[keep]]
            x["s"], x["n"], x["rel"] = s + start[c.doc[keep]], e - s, rel
            held.append(x)
            size += len(x)
        if size > _FLUSH:
            yield from _blobs(flush())
            held, size = [], 0
    if held:
        yield from _blobs(flush())


def _first_contexts(batches):
    got = _gather(batches, {0: _C, 1: _C})
    x = got[0][np.lexsort((got[0]["s"], got[0]["id"], got[0]["c2"], got[0]["c1"]))]
    again = same_as_before(x["c1"], x["c2"])
    for first, y in ((True, x[~again]), (False, np.concatenate([x[again], got[1]]))):
        for lo in range(0, len(y), 200_000):
            z = y[lo : lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), first)), *(pa.array(np.ascontiguousarray(v)) for v in (z["h"].astype(np.int64), z["id"], z["s"], z["n"], z["rel"]))], ["first", "h", "id", "s", "n", "rel"])


def _windows(batches, depth, n):
    """Bytes of first contexts (by anchor), and window hashes of those of very frequent anchors."""
    trim()
    held, wide, size = [], [], 0

    def flush():
        if held:
            meta, data = np.concatenate([m for m, _ in held]), [d for _, d in held]
            text = np.concatenate(data)
            at = np.zeros(len(meta) + 1, np.int64)
            np.cumsum(meta["n"], out=at[1:])
            bucket = ((meta["h"] >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for a, b in zip(cut, cut[1:], strict=False):
                rows = order[a:b]
                body = np.concatenate([text[at[r] : at[r + 1]] for r in rows])
                yield int(bucket[rows[0]]), 0, np.int64(len(rows)).tobytes() + meta[rows].tobytes() + body.tobytes()
        if wide:
            x = np.concatenate(wide)
            x = x[np.lexsort((x["s"], x["id"], x["w2"], x["w1"]))]
            again = same_as_before(x["w1"], x["w2"])
            for kind, rows, by in ((1, x[~again], x["w1"][~again]), (2, x[again], mix(x["id"][again].astype(np.uint64)))):
                for k, d in pack_by(((by >> np.uint64(20)) % np.uint64(n)).astype(np.int64), rows):
                    yield k, kind, d

    for batch in batches:
        col = _lists(batch, "places")
        counts = np.diff(col.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), counts)
        flat = col.flatten()
        f = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("h", "s", "n", "rel", "wide")}
        for c, ids, start, lo, hi in _chunks_of(batch, depth):
            a, b = np.searchsorted(row, [lo, hi])
            if a == b or not len(c.raw):
                continue
            r = row[a:b] - lo
            s = f["s"][a:b] - start[r]
            # A context lies in this piece of its text or in another one.
            ok = (s >= c.off[r]) & (s + f["n"][a:b] <= c.off[r + 1])
            s, r, at = s[ok], r[ok], np.arange(a, b)[ok]
            m = np.zeros(len(s), _X)
            m["h"], m["id"], m["s"], m["n"], m["rel"] = f["h"][at].astype(np.uint64), ids[r], f["s"][at], f["n"][at], f["rel"][at]
            hot = f["wide"][at].astype(bool)
            if (~hot).any():
                own = m[~hot]
                held.append((own, np.concatenate([c.raw[x : x + k] for x, k in zip(s[~hot], own["n"], strict=True)])))
                size += int(own["n"].sum())
            if hot.any():
                times = m["n"][hot] - depth + 1
                first = np.repeat(s[hot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                x = np.zeros(len(first), _W)
                x["w1"], x["w2"] = c.hashes(first, first + depth)
                x["id"], x["s"] = np.repeat(m["id"][hot], times), first + np.repeat(start[r[hot]], times)
                wide.append(x)
                size += 32 * len(x)
        if size > 16 << 20:
            yield from _blobs(flush())
            held, wide, size = [], [], 0
    yield from _blobs(flush())


def radix_groups(text: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix numbers, group numbers) of suffixes that share their first `depth` bytes with another one.

    Most-significant-digit radix sort: each pass reads the next 8 bytes of the suffixes still in question,
    splits their groups by them and drops suffixes that stand alone. group: a first split, if known.
    """
    alive = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64) if group is None else group
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for at in range(0, depth, 8):
        take = min(8, depth - at)
        digit = np.zeros(len(alive), np.uint64)
        for k in range(take):
            digit = (digit << np.uint64(8)) | padded[starts[alive] + (at + k)].astype(np.uint64)
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        same = same_as_before(group, digit)
        keep = same.copy()
        keep[:-1] |= same[1:]
        group = np.cumsum(~same)[keep]
        alive = alive[keep]
        if not len(alive):
            break
    return alive, group


def _spans(ids, s, e):
    """Union of the spans of each document, as rows."""
    order = np.lexsort((s, ids))
    ids, s, e = ids[order], s[order], e[order]
    if not len(ids):
        return
    # Ends so far within a document: spans of one length or sorted starts make a running maximum enough.
    doc = np.cumsum(np.r_[True, ids[1:] != ids[:-1]]) - 1
    shift = int(e.max() - s.min() + 1)
    if doc[-1] * shift < 1 << 62:
        reach = np.maximum.accumulate(e - s.min() + doc * shift) - doc * shift + s.min()
    else:
        reach = e
    new = np.r_[True, (ids[1:] != ids[:-1]) | (s[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(ids) - 1]
    for lo in range(0, len(at), 200_000):
        a, b = at[lo : lo + 200_000], last[lo : lo + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(s[a]), pa.array(reach[b])], ["id", "s", "e"])


def _compare(batches, depth):
    trim()
    got = _gather(batches, {0: None, 1: _W, 2: _W})
    ids, s = [got[2]["id"]], [got[2]["s"]]
    x = got[1][np.lexsort((got[1]["s"], got[1]["id"], got[1]["w2"], got[1]["w1"]))]
    again = same_as_before(x["w1"], x["w2"])
    ids.append(x["id"][again])
    s.append(x["s"][again])
    metas, texts = [], []
    for d in got[0]:
        k = int(np.frombuffer(d[:8], np.int64)[0])
        metas.append(np.frombuffer(d, _X, k, 8))
        texts.append(np.frombuffer(d, np.uint8, offset=8 + k * _X.itemsize))
    if metas:
        meta, text = np.concatenate(metas), np.concatenate(texts)
        base = np.cumsum(meta["n"].astype(np.int64)) - meta["n"]
        order = np.argsort(meta["h"], kind="stable")
        meta, base = meta[order], base[order]
        # Whole groups at a time, so that memory holds the windows of a bounded number of contexts.
        edges = np.flatnonzero(np.r_[~same_as_before(meta["h"]), True])
        lo = 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 8_000, side="right")) - 1)
            m, b = meta[edges[lo] : edges[hi]], base[edges[lo] : edges[hi]]
            times = m["n"] - depth + 1
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own = np.repeat(np.arange(len(m)), times)
            # Equal windows have their anchor at the same distance.
            group = np.repeat(np.cumsum(~same_as_before(m["h"])), times) * depth + np.repeat(m["rel"], times) - inner
            alive, group = radix_groups(text, b[own] + inner, depth, group)
            i, at = m["id"][own[alive]], m["s"][own[alive]] + inner[alive]
            order = np.lexsort((at, i, group))
            late = same_as_before(group[order])
            ids.append(i[order][late])
            s.append(at[order][late])
            lo = hi
    ids, s = np.concatenate(ids), np.concatenate(s)
    yield from _spans(ids, s, s + depth)


def _result(batches, with_text, carry):
    trim()
    for batch in batches:
        raw, off = buffers(batch.column("text"))
        col = _lists(batch, "spans")
        counts = np.diff(col.offsets.to_numpy())
        flat = col.flatten()
        sa, ea = (flat.field(k).to_numpy() for k in ("s", "e"))
        j = batch.column("j").to_numpy()
        removed, n_spans, sha, kept = [], [], [], []
        at = 0
        for r in range(batch.num_rows):
            text = raw[off[r] : off[r + 1]]
            base = int(j[r]) << _ROW_SHIFT
            k = int(counts[r])
            s, e = sa[at : at + k] - base, ea[at : at + k] - base
            at += k
            ok = (s >= 0) & (s < 1 << _ROW_SHIFT)
            if ok.any():
                mark = np.zeros(len(text) + 1, np.int32)
                np.add.at(mark, s[ok], 1)
                np.add.at(mark, e[ok], -1)
                gone = np.cumsum(mark[:-1]) > 0
                removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                text = text[~gone]
            else:
                removed.append(0)
                n_spans.append(0)
            data = text.tobytes()
            sha.append(hashlib.sha256(data).hexdigest())
            kept.append(data.decode("utf-8", "ignore") if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(batch.column(c) for c in carry), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept, pa.string())],
            ["id", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


#: Rows without an id get numbers of their own from here up to half of this, drawn by hash: below all ids.
_NULL_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: list[str] | None = None, wide: int = WIDE) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the text that is left.

    A byte is removed if a string of `depth` bytes covers it that also starts earlier: in a row with a smaller id,
    or in the same text further left. Strings are judged on the input, so overlapping repeats count whole.

    Null or empty texts and texts shorter than depth lose nothing; rows without an id sort first, in an order
    drawn by hash (ids must not be below -2 ** 62); rows that share an id are ordered by a hash of their texts, so of
    equal rows one stays whole; an empty table gives an empty result. Texts of
    any length are read whole. Other columns are ignored unless named in carry. The kept text is cut on byte
    positions; bytes of a character of which only a part is left are dropped from it (not from kept_sha256).
    depth must be at least 60.
    """
    if depth < ANCHOR + 9:
        raise ValueError(f"depth must be at least {ANCHOR + 9}")
    spark = docs.sparkSession
    ship(spark)
    n = parts_for(docs)
    carry = carry or []
    from pyspark.sql import Window

    drawn = F.lit(_NULL_ID) + F.pmod(F.xxhash64(text_col, F.monotonically_increasing_id()), F.lit(1 << 61))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), drawn).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows.repartition(n, "id").withColumn("j", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"))) - 1)
    texts = bucketed(rows, "id", n, "texts")
    del rows
    release(spark)

    text = texts.select("id", "j", "text")
    places = text.mapInArrow(lambda it: _anchors(it, depth, n), "bucket int, kind int, data binary")
    places = scratch(places.repartitionById(n, "bucket").mapInArrow(_repeated, "id long, pos long"), "places")
    release(spark)

    def beside(narrow: DataFrame, how: str) -> DataFrame:
        return text.join(narrow.hint("shuffle_hash"), "id", how)

    by_doc = places.groupBy("id").agg(F.collect_list("pos").alias("places"))
    found = beside(by_doc, "inner").mapInArrow(lambda it: _contexts(it, depth, n), "bucket int, kind int, data binary")
    found = scratch(found.repartitionById(n, "bucket").mapInArrow(_first_contexts, "first boolean, h long, id long, s long, n int, rel int"), "contexts")
    release(spark)

    first = found.where("first")
    # Written first, so that both sides of the join are plain shuffles, which Spark splits where a key is hot.
    many = scratch(first.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1"), "many")
    fresh = first.join(many, "h").select("id", F.struct("h", "s", "n", "rel", (F.col("contexts") > wide).alias("wide")).alias("x"))
    by_doc = fresh.groupBy("id").agg(F.collect_list("x").alias("places"))
    near = beside(by_doc, "inner").mapInArrow(lambda it: _windows(it, depth, n), "bucket int, kind int, data binary")
    near = near.repartitionById(n, "bucket").mapInArrow(lambda it: _compare(it, depth), "id long, s long, e long")
    spans = near.union(found.where("NOT first").select("id", "s", (F.col("s") + F.col("n")).alias("e")))
    by_doc = scratch(spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    release(spark)

    for t in (places, found, many):
        drop_scratch(t)
    names = [f"carry_{c}" for c in carry]
    no_span = F.expr("array_remove(array(named_struct('s', 0L, 'e', 0L)), named_struct('s', 0L, 'e', 0L))")
    both = texts.select("id", "j", "text", *names).join(by_doc.hint("shuffle_hash"), "id", "left").withColumn("spans", F.coalesce("spans", no_span))
    schema = "".join(f"{c} {t}, " for c, t in both.dtypes if c == "id" or c in names)
    out = both.select("id", "j", "text", "spans", *names).mapInArrow(lambda it: _result(it, with_text, names), schema + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.select(F.when(F.col("id") >= _NULL_ID // 2, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []), *[F.col(f"carry_{c}") for c in carry])
