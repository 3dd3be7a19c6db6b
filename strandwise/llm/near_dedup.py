"""Near-duplicate classes by weighted Jaccard similarity of word shingles: BagMinHash, bands, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buffers, chunks, drop_scratch, mix, pack_by, parts_for, release, same_as_before, scratch, ship, trim, windows_of, words_of
from .suffix_dedup import _blobs, _gather

#: Bands times rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 26 < 4e-5.
BANDS, ROWS = 26, 5
#: Members and bytes of text of a block of a bucket that holds several classes (memory of a cell, not a cap).
BLOCK, BLOCK_BYTES = 256, 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_K = np.dtype([("key", "<u8"), ("u", "<i8")])
_E = np.dtype([("u", "<i8"), ("v", "<i8"), ("n", "<i8")])
#: Pairs with one text beyond which its partners are dealt to several tasks, each with a copy of that text.
HOT = 128
#: Bytes of a worker's memory below which a task leaves it as it is (a fresh one with its libraries holds about 115 MB).
SMALL = 192 << 20
#: Edges (16 bytes each) that the driver joins to components itself; more of them stay in tables.
FEW = 1 << 16
#: Points of Poisson processes drawn at once (bounds the memory of a task).
POINTS = 1 << 20


def shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `width` words; a text of fewer words, but not none, is one run."""
    _, _, _, doc, h = words_of(raw, off)
    at, win = windows_of(h, doc, width)
    docs, wins = [doc[at]], [win]
    per = np.bincount(doc, minlength=len(off) - 1)
    for n in range(1, width):
        if (per == n).any():
            at, win = windows_of(h, doc, n)
            short = per[doc[at]] == n
            docs.append(doc[at][short])
            wins.append(win[short])
    return np.concatenate(docs), np.concatenate(wins)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (text, hash) with counts."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    at = np.flatnonzero(~same_as_before(doc, h))
    return doc[at], h[at], np.diff(np.r_[at, len(doc)])


def _text_runs(own: np.ndarray, most: int):
    """Ranges of about `most` elements, cut between texts."""
    lo = 0
    while lo < len(own):
        hi = min(lo + most, len(own))
        if hi < len(own):
            hi = max(int(np.searchsorted(own, own[hi])), int(np.searchsorted(own, own[lo], side="right")))
        yield lo, hi
        lo = hi


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m) of multisets given as distinct (text, hash, count); 0 where a text has no element.

    The weight axis is discretised into [0,1), [1,2), [2,4), [4,8) ... . An element of weight w has one Poisson
    process for each of these intervals below w, with the interval's length as its rate for each of m places, so
    equal elements yield equal points. In the interval that w cuts, a point counts if the dyadic path drawn for
    it ends below w. The signature at a place is the identity of the earliest point there, so two signatures
    agree at a place with probability sum(min)/sum(max) of the weights. Points come in rising order, in blocks,
    until a text's processes have passed the latest of its m minima.
    """
    sig = np.zeros((n, m), np.uint64)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    elem = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(elem)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    size = np.maximum(low, 1)
    weight = count[elem]
    seed = mix(h[elem] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    own = doc[elem]
    mass = np.bincount(own, weights=np.minimum(size, weight - low), minlength=n)
    block = np.ones(n, np.int64)
    some = mass > 0
    block[some] = 1 << np.ceil(np.log2(1 + m * 6 / np.bincount(own, minlength=n)[some])).astype(np.int64)
    work = [np.flatnonzero(block[own] == b) for b in np.unique(block[some])]
    work = [w[x:y] for w in work for x, y in _text_runs(own[w], max(1, POINTS // int(block[own[w[0]]])))]
    for pick in work:
        b = block[own[pick[0]]]
        names, local = np.unique(own[pick], return_inverse=True)
        best = np.full(len(names) * m, np.inf)
        who = np.zeros(len(names) * m, np.uint64)
        t, k = np.zeros(len(pick)), np.zeros(len(pick), np.uint64)
        while len(pick):
            r = mix(seed[pick][:, None] + (k[:, None] + np.arange(1, b + 1, dtype=np.uint64)) * _GOLD)
            gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (m * size[pick])[:, None]
            time = t[:, None] + np.cumsum(gap, axis=1)
            r2 = mix(r)
            slot = local[:, None] * m + (r2 % np.uint64(m)).astype(np.int64)
            path = (mix(r2) % size[pick].astype(np.uint64)[:, None]).astype(np.int64)
            good = (low[pick][:, None] + path < weight[pick][:, None]) & (time < best[slot])
            slot, at, name = slot[good], time[good], r2[good]
            np.minimum.at(best, slot, at)
            won = best[slot] == at
            who[slot[won]] = name[won]
            last = best.reshape(-1, m).max(axis=1)
            t, k = time[:, -1], k + np.uint64(b)
            on = t < last[local]
            pick, local, t, k = pick[on], local[on], t[on], k[on]
        sig[names] = who.reshape(-1, m)
    return sig


def _signatures(batches, width, bands, rows):
    trim(SMALL)
    for batch in batches:
        raw, off = buffers(batch.column("text"))
        u = batch.column("u").to_numpy()
        for lo, hi in chunks(off):
            d, h = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
            if not len(d):
                continue
            d, h, c = counted(d, h)
            sig = bag_minhash(d, h, c, hi - lo, bands * rows)
            key = np.zeros((hi - lo, bands), np.uint64)
            for r in range(rows):
                key = mix(key * np.uint64(3) + sig[:, r::rows][:, :bands] + np.arange(bands, dtype=np.uint64))
            some = np.unique(d)
            keys = [k.tobytes() for k in key[some]]
            size = (off[lo + 1 : hi + 1] - off[lo:hi])[some]
            yield pa.RecordBatch.from_arrays([pa.array(u[lo:hi][some]), pa.array(keys, pa.binary()), pa.array(size)], ["u", "keys", "size"])


def _sum_edges(e):
    """Equal edges as one, with their counts added."""
    e = e[np.lexsort((e["v"], e["u"]))]
    at = np.flatnonzero(~same_as_before(e["u"], e["v"]))
    out = e[at].copy()
    if len(at):
        out["n"] = np.add.reduceat(e["n"], at)
    return out


def _edges(x):
    """Each member of a bucket with its first one, and in how many buckets that is so."""
    x = x[np.lexsort((x["u"], x["key"]))]
    again = same_as_before(x["key"])
    at = np.flatnonzero(again)
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(x)))) if len(x) else at
    e = np.ones(len(at), _E)
    e["u"], e["v"] = x["u"][at], x["u"][first[at]]
    return x[~again], _sum_edges(e[e["u"] != e["v"]])


def _local(batches, bands, n):
    trim(SMALL)
    held, size = [], 0

    def flush():
        one, e = _edges(np.concatenate(held))
        for kind, rows, by in ((0, one, one["key"]), (1, e, mix(e["u"].astype(np.uint64)))):
            for k, d in pack_by(((by >> np.uint64(20)) % np.uint64(n)).astype(np.int64), rows):
                yield k, kind, d

    for batch in batches:
        keys = batch.column("keys").to_pylist()
        x = np.zeros(len(keys) * bands, _K)
        x["key"] = np.frombuffer(b"".join(keys), np.uint64) + np.zeros(0 if not keys else len(keys) * bands, np.uint64)
        x["u"] = np.repeat(batch.column("u").to_numpy(), bands)
        held.append(x)
        size += len(x)
        if size > 500_000:
            yield from _blobs(flush())
            held, size = [], 0
    if held:
        yield from _blobs(flush())


def _global(batches):
    got = _gather(batches, {0: _K, 1: _E})
    e = _sum_edges(np.concatenate([_edges(got[0])[1], got[1]]))
    for lo in range(0, len(e), 200_000):
        y = e[lo : lo + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(y[c].copy()) for c in ("u", "v", "n")], ["u", "v", "n"])


def similarities(raw_a, off_a, raw_b, off_b, width: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of texts a[i] and b[i]."""
    n = len(off_a) - 1
    da, ha = shingles(raw_a, off_a, width)
    db, hb = shingles(raw_b, off_b, width)
    doc, h = np.r_[da, db], np.r_[ha, hb]
    side = np.r_[np.zeros(len(da), np.int64), np.ones(len(db), np.int64)]
    order = np.lexsort((h, doc))
    doc, h, side = doc[order], h[order], side[order]
    at = np.flatnonzero(~same_as_before(doc, h))
    if not len(at):
        return np.zeros(n)
    b = np.add.reduceat(side, at)
    a = np.diff(np.r_[at, len(doc)]) - b
    low = np.bincount(doc[at], weights=np.minimum(a, b), minlength=n)
    high = np.bincount(doc[at], weights=np.maximum(a, b), minlength=n)
    return low / np.maximum(high, 1)


def _verify(batches, width, least):
    trim(SMALL)
    for batch in batches:
        (ra, oa), (rb, ob) = buffers(batch.column("text")), buffers(batch.column("text_v"))
        ok = np.zeros(batch.num_rows, bool)
        for lo, hi in chunks(oa + ob):
            s = similarities(ra[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo], rb[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo], width)
            ok[lo:hi] = s >= least - 1e-12
        if ok.any():
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


def _flat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _common(batches):
    """The buckets that two texts share."""
    for batch in batches:
        a, b = _flat(batch.column("keys"), np.int64), _flat(batch.column("keys_v"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(a[a == b]))], ["key"])


def _members(batches, bands):
    for batch in batches:
        key = _flat(batch.column("keys"), np.int64)
        rest = [pa.array(np.repeat(batch.column(c).to_numpy(), bands)) for c in ("u", "root", "size")]
        yield pa.RecordBatch.from_arrays([pa.array(key), *rest], ["key", "u", "root", "size"])


def overlaps(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, sums of minima of all pairs) of the shingle multisets of a few texts, by products of 0/1 matrices.

    The k-th occurrence of a shingle is an element of its own, which turns multisets into sets.
    """
    n = len(off) - 1
    doc, h, count = counted(*shingles(raw, off, width))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(doc, count)
    _, col, held = np.unique(mix(np.repeat(h, count) + nth.astype(np.uint64) * _GOLD), return_inverse=True, return_counts=True)
    sizes = np.bincount(doc, minlength=n)
    shared = held > 1
    doc, col = doc[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        x, y = np.searchsorted(col, [lo, lo + 2048])
        block = np.zeros((n, 2048), np.float32)
        block[doc[x:y], col[x:y] - lo] = 1
        both += block @ block.T
    return sizes, both.astype(np.float64)


def joining_links(linked: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join the classes of a matrix of links, fewer than there are classes."""
    label = np.unique(root, return_inverse=True)[1]
    top = len(label)
    out = []
    while True:
        low = np.where(linked, label[None, :], top).min(axis=1)
        best = np.flatnonzero(low < label)
        if not len(best):
            return out
        best = best[np.lexsort((low[best], label[best]))]
        best = best[~same_as_before(label[best])]
        out += [(int(i), int(np.flatnonzero(linked[i] & (label == low[i]))[0])) for i in best]
        to = np.arange(top)
        to[label[best]] = low[best]
        label = to[label]


def _cells(batches, width, least):
    """Rows sorted by cell; a cell may go on in the next batch."""
    trim(SMALL)
    rest = None

    def links_of(t):
        t = t.combine_chunks()
        u, root = (t.column(c).to_numpy() for c in ("u", "root"))
        raw, off = buffers(t.column("text"))
        cut = np.flatnonzero(np.r_[~same_as_before(*(t.column(c).to_numpy() for c in _CELL)), True])
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if (root[x:y] == root[x]).all():
                continue
            sizes, both = overlaps(raw[off[x] : off[y]], off[x : y + 1] - off[x], width)
            linked = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1) >= least - 1e-12
            found = joining_links(linked, root[x:y])
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(u[x:y][i]), pa.array(u[x:y][j])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = int(np.flatnonzero(~same_as_before(*(t.column(c).to_numpy() for c in _CELL)))[-1])
        if last:
            yield from links_of(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None:
        yield from links_of(rest)


_CELL = ("key", "ga", "gb", "i", "j")


def cells_of(member: DataFrame) -> DataFrame:
    """(key, ga, gb, i, j, u, root): the cells in which members (key, u, root, size) of buckets meet members of other classes.

    A class with more than a block in a bucket has blocks of its own; all smaller classes share the group -1. Blocks
    meet only if their groups differ, or within the group of small classes; so members of one large class never
    meet, and a bucket of one large class and a few other texts costs in proportion to its size.
    """
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    kinds = member.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    kinds = scratch(kinds.withColumn("grp", F.when(blocks(F.col("n"), F.col("bytes")) > 1, F.col("root")).otherwise(F.lit(-1).cast("long"))), "kinds")
    groups = scratch(kinds.groupBy("key", "grp").agg(blocks(F.sum("n"), F.sum("bytes")).alias("blocks")), "groups")
    member = member.join(kinds.select("key", "root", "grp"), ["key", "root"]).join(groups, ["key", "grp"])
    member = scratch(member.withColumn("block", F.expr("CAST(pmod(xxhash64(u), blocks) AS INT)")), "blocks")
    one, two = (groups.select("key", F.col("grp").alias(g), F.col("blocks").alias(b)) for g, b in (("ga", "na"), ("gb", "nb")))
    meet = scratch(one.join(two, "key").where("ga < gb"), "meet")
    first = member.withColumnRenamed("grp", "ga").join(meet, ["key", "ga"]).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("i", F.col("block"))
    second = member.withColumnRenamed("grp", "gb").join(meet, ["key", "gb"]).withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("j", F.col("block"))
    own = member.where("grp = -1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("blocks = 1 OR other != block")
    own = own.withColumns({"ga": F.col("grp"), "gb": F.col("grp"), "i": F.least("block", "other"), "j": F.greatest("block", "other")})
    cols = [*_CELL, "u", "root"]
    return first.select(cols).unionByName(second.select(cols)).unionByName(own.select(cols))


def remaining_links(table: DataFrame, signed: DataFrame, pairs: DataFrame, roots: DataFrame, n: int, width: int, least: float) -> DataFrame | None:
    """Links (u, v) between different classes that share a bucket: enough of them to join these classes.

    The compared pairs of a bucket connect it, so a bucket holds several classes only if one of its pairs failed.
    Just those buckets are looked at again: their members meet in cells (cells_of) of bounded size with their texts,
    where all similarities are computed exactly; only links that join classes leave the cell, fewer than it has
    members. None if no bucket has several classes.
    """
    who = scratch(signed.join(roots, "u").select("u", "root", "size", "keys"), "touched")
    right = who.select(F.col("u").alias("v"), F.col("root").alias("root_v"), F.col("keys").alias("keys_v"))
    failed = scratch(pairs.select("u", "v").join(who.select("u", "root"), "u").join(right.select("v", "root_v"), "v").where("root != root_v").select("u", "v"), "failed")
    mixed = failed.join(who.select("u", "keys"), "u").join(right.select("v", "keys_v"), "v").select("keys", "keys_v")
    mixed = scratch(mixed.mapInArrow(_common, "key long").distinct(), "mixed")
    if mixed.isEmpty():
        return None
    member = scratch(who.mapInArrow(lambda it: _members(it, BANDS), "key long, u long, root long, size long").join(mixed, "key"), "members")
    cell = table.select("u", "text").join(cells_of(member).hint("shuffle_hash"), "u").repartition(n, *_CELL).sortWithinPartitions(*_CELL)
    return scratch(cell.select(*_CELL, "u", "root", "text").mapInArrow(lambda it: _cells(it, width, least), "u long, v long"), "rest")


def verified(table: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough. Texts of u move to v's bucket; a text with very many partners is copied to several tasks instead."""
    spark = table.sparkSession
    many = scratch(pairs.groupBy("v").agg(F.count("*").alias("n")).where(f"n > {HOT}"), "hot")
    left = table.select("u", "text")
    right = table.select(F.col("u").alias("v"), F.col("text").alias("text_v"))
    cold = pairs.join(many, "v", "left_anti").select("u", "v")
    cols = ["u", "v", "text", "text_v"]
    both = right.join(left.join(cold.hint("shuffle_hash"), "u").hint("shuffle_hash"), "v").select(cols)
    if not many.isEmpty():
        salted = scratch(pairs.join(many, "v").select("u", "v", F.expr(f"CAST(pmod(xxhash64(u), 1 + n div {HOT}) AS INT)").alias("salt")), "salted")
        copies = right.join(salted.select("v", "salt").distinct().hint("shuffle_hash"), "v")
        both = both.unionByName(left.join(salted.hint("shuffle_hash"), "u").join(copies, ["v", "salt"]).select(cols))
    out = scratch(both.mapInArrow(lambda it: _verify(it, width, least), "u long, v long"), "links")
    release(spark)
    return out


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(u, root) after joining the classes of `roots` by the links (u, v) between its members."""
    e = links.join(roots, "u").select("v", F.col("root").alias("a")).join(roots.withColumnRenamed("u", "v"), "v").where("a != root")
    e = scratch(e.select(F.col("a").alias("u"), F.col("root").alias("v")), "between")
    n = e.count()
    if not n:
        return roots
    to = (few_components(e) if n <= FEW else components(e)).select(F.col("u").alias("root"), F.col("root").alias("to"))
    return scratch(roots.join(to, "root", "left").select("u", F.coalesce("to", "root").alias("root")), "roots")


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the smallest vertex that each one reaches over the edges u[i] - v[i])."""
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while (root[a] != root[b]).any():
        low = np.arange(len(names))
        np.minimum.at(low, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (low[low] != low).any():
            low = low[low]
        root = low[root]
    return names, names[root]


def few_components(edges: DataFrame) -> DataFrame:
    """components() of at most FEW edges, worked out by the driver: rounds over small tables take long for what they do."""
    t = edges.select("u", "v").toArrow()
    u, root = smallest_reached(*(t.column(c).to_numpy() for c in ("u", "v")))
    return edges.sparkSession.createDataFrame(pa.table({"u": u, "root": root}))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex: the smallest vertex reached over the edges (u, v).

    Each round takes the smallest label among the neighbours and then the label's own label, so chains shorten by
    half; rounds end when nothing changes. Labels are tables in the shared folder; none is collected.
    """
    both = scratch(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        low = labels.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("u").alias("root"), F.col("root").alias("next"))
        new = scratch(low.join(jump, "root").select("u", F.least("root", "next").alias("root"), "old"), "labels")
        if new.where("root != old").limit(1).count() == 0:
            return new.select("u", "root")
        labels = new.select("u", "root")


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: id, class_id (the smallest id of its class) and keep (true for one row of each class).

    Two texts are linked if the multisets of their runs of `width` words (words as in decontamination; a shorter
    text is one run) have weighted Jaccard similarity of at least `least`; classes are the connected components.
    Equal texts are one text. Candidates share a band of their BagMinHash signatures; each text is compared
    exactly with the text that comes first in most of its buckets, and with the first ones of the others as long as
    they are in another class, so a hot bucket stays linear. Buckets that then still hold several classes are gone
    through again, block by block, and the members of different classes are compared exactly, so every link between
    texts that share a bucket counts.

    Texts without words (null and empty ones too) are classes of their own; rows may share an id or repeat; of ties
    the row read first is kept; an empty table gives an empty result; columns in carry are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    n = parts_for(docs)
    carry = carry or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    has_words = F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    rows = rows.withColumn("same", F.when(has_words, F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    table = bucketed(rows, "u", n, "near")
    del rows
    release(spark)

    # The row of the smallest id (then the first read) stands for all rows of its text.
    lead = table.where("same IS NOT NULL").groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "u")).alias("lead"))
    lead = scratch(lead.select("same", F.col("lead.u").alias("rep")), "lead")
    one = table.select("u", "text").join(lead.select(F.col("rep").alias("u")).hint("shuffle_hash"), "u")
    signed = scratch(one.mapInArrow(lambda it: _signatures(it, width, BANDS, ROWS), "u long, keys binary, size long"), "signatures")
    release(spark)
    pairs = signed.repartition(n, "u").mapInArrow(lambda it: _local(it, BANDS, n), "bucket int, kind int, data binary")
    pairs = pairs.repartitionById(n, "bucket").mapInArrow(_global, "u long, v long, n long")
    # A text has BANDS partners at most: they move once, to their text, which also finds the one met in most buckets.
    pairs = pairs.repartition(n, "u").groupBy("u", "v").agg(F.sum("n").alias("n"))
    pairs = pairs.groupBy("u").agg(F.expr("max_by(v, struct(n, -v))").alias("first"), F.collect_list("v").alias("v"))
    pairs = scratch(pairs.select("u", "first", F.explode("v").alias("v")).select("u", "v", F.expr("v = first").alias("likely")), "pairs")
    release(spark)
    # First each text with the one it meets in most buckets; then, of all other pairs, those still in different classes.
    likely = pairs.where("likely").select("u", "v")
    alone = scratch(pairs.select("u").union(pairs.select("v")).distinct().select("u", F.col("u").alias("root")), "roots")
    roots = joined(alone, verified(table, likely, width, least))
    apart = pairs.where("NOT likely").select("u", "v").join(roots, "u").join(roots.select(F.col("u").alias("v"), F.col("root").alias("root_v")), "v").where("root != root_v")
    apart = scratch(apart.select("u", "v"), "apart")
    roots = joined(roots, verified(table, apart, width, least))
    rest = remaining_links(table, signed, pairs, roots, n, width, least)
    if rest is not None:
        release(spark)
        roots = joined(roots, rest)

    member = table.select("u", "id", "same").join(lead, "same", "left")
    member = member.join(roots.select(F.col("u").alias("rep"), "root"), "rep", "left")
    member = member.withColumn("root", F.coalesce("root", "rep", "u"))
    member = scratch(member, "members")
    # Written first, so that both sides of the join are plain shuffles, which Spark splits where a class is large.
    best = scratch(member.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "u")).alias("best")), "best")
    member = member.join(best, "root").select("u", "id", F.col("best.id").alias("class_id"), (F.col("u") == F.col("best.u")).alias("keep"))
    if carry:
        # Decisions move to the texts' buckets; the texts stay where they are.
        member = scratch(member, "classes")
        for t in (lead, signed, pairs):
            drop_scratch(t)
        release(spark)
        member = table.select("u", *[f"carry_{c}" for c in carry]).join(member.hint("shuffle_hash"), "u")
    return member.select(F.col("id").alias(id_col), "class_id", "keep", *[F.col(f"carry_{c}") for c in carry])
