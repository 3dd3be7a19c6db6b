"""Scores of seeds against every row, in one vectorised pass over the features for each block of seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

DENSE, SPARSE = ("semantic", "numerics", "image"), ("tfidf", "authors")
TRACKS = ("tfidf", "semantic", "authors", "numerics", "image")
#: Seeds that are sent to all tasks at once; more of them are scored block by block.
SEEDS = 256
#: Scores, and products of weights, that a task works out at once.
CELLS = 1 << 20
#: Share of a block's seeds from which a term is multiplied as a column of a matrix.
COMMON = 0.05


def dense_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which are there) of a list column; a zero vector stays zero, null is not there."""
    there = col.is_valid().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = len(flat) // max(1, int(there.sum()))
    out = np.zeros((len(col), size))
    out[there] = flat.reshape(-1, size) if size else 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), there


def sparse_rows(ids: pa.Array, w: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, weight) of all entries, and which rows are there."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(ids)), size), ids.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), there


class SeedBlock:
    """The vectors of a block of seeds, as they are sent to the tasks."""

    def __init__(self, table: pa.Table, tracks: tuple[str, ...], gated: dict[str, bool]):
        table = table.combine_chunks()
        column = lambda c: table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type)
        self.ids = column("book_id").to_numpy(zero_copy_only=False)
        self.tracks, self.dense, self.sparse = tracks, {}, {}
        self.there = {}
        for t in tracks:
            if t in DENSE:
                self.dense[t], self.there[t] = dense_rows(column(t))
            else:
                row, ids, w, self.there[t] = sparse_rows(column(f"{t}_ids"), column(f"{t}_w"))
                order = np.argsort(ids, kind="stable")
                terms, first = np.unique(ids[order], return_index=True)
                first = np.r_[first, len(ids)]
                many = np.diff(first)
                common = np.flatnonzero(many >= max(8, COMMON * len(self.ids)))
                dense = np.zeros((len(common), len(self.ids)))
                for k, at in enumerate(common):
                    dense[k] = np.bincount(row[order][first[at] : first[at + 1]], weights=w[order][first[at] : first[at + 1]], minlength=len(self.ids))
                place = np.full(len(terms), -1)
                place[common] = np.arange(len(common))
                self.sparse[t] = (terms, first, row[order], w[order], place, dense)
            if not gated.get(t, True):
                self.there[t] = np.zeros_like(self.there[t])
        self.bits = sum((self.there[t].astype(np.int32) << TRACKS.index(t) for t in tracks), np.zeros(len(self.ids), np.int32))

    def scores(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """Scores (rows x seeds) of each track; NaN where seed or row has no vector."""
        n, s, out = batch.num_rows, len(self.ids), {}
        for t in self.tracks:
            if t in DENSE:
                x, there = dense_rows(batch.column(t))
                got = x @ self.dense[t].T if there.any() and self.there[t].any() else np.zeros((n, s))
            else:
                row, ids, w, there = sparse_rows(batch.column(f"{t}_ids"), batch.column(f"{t}_w"))
                terms, first, seed, seed_w, place, dense = self.sparse[t]
                at = np.minimum(np.searchsorted(terms, ids), max(len(terms) - 1, 0))
                hit = np.flatnonzero(terms[at] == ids) if len(terms) else np.zeros(0, np.int64)
                row, w, at = row[hit], w[hit], at[hit]
                often, h = place[at] >= 0, len(dense)
                base = np.zeros((n, s))
                if often.any():  # frequent terms as one matrix product
                    base = np.bincount(row[often] * h + place[at[often]], weights=w[often], minlength=n * h).reshape(n, h) @ dense
                    row, w, at = row[~often], w[~often], at[~often]
                many = first[at + 1] - first[at] if len(at) else np.zeros(0, np.int64)
                got = np.zeros(n * s)
                cut = np.searchsorted(np.cumsum(many), np.arange(CELLS, int(many.sum()) + CELLS, CELLS)) + 1
                lo = 0
                for hi in np.minimum(cut, len(at)):
                    k = many[lo:hi]
                    to = np.repeat(first[at[lo:hi]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    got += np.bincount(np.repeat(row[lo:hi], k) * s + seed[to], weights=np.repeat(w[lo:hi], k) * seed_w[to], minlength=n * s)
                    lo = int(hi)
                got = got.reshape(n, s) + base
            got[~there] = np.nan
            got[:, ~self.there[t]] = np.nan
            out[t] = got
        return out


def seed_blocks(features: DataFrame, seeds: DataFrame, tracks: tuple[str, ...], gated: dict[str, bool]) -> Iterator[SeedBlock]:
    """The seeds (seed) with their vectors, at most about SEEDS at a time."""
    chosen = features.join(seeds.select(F.col("seed").alias("book_id")).distinct(), "book_id", "left_semi").select("book_id", *columns(tracks))
    n = -(-seeds.count() // SEEDS)
    for k in range(n):
        table = (chosen if n == 1 else chosen.where(F.pmod(F.xxhash64("book_id"), F.lit(n)) == k)).toArrow()
        if table.num_rows:
            yield SeedBlock(table, tracks, gated)


def columns(tracks: tuple[str, ...]) -> list[str]:
    return [c for t in tracks for c in ((f"{t}_ids", f"{t}_w") if t in SPARSE else (t,))]


def _pieces(batches, block):
    for b in batches:
        step = max(1, CELLS // max(1, len(block.ids)))
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            yield part.column("book_id").to_numpy(zero_copy_only=False), block.scores(part)


def _all(batches, sent):
    block = sent.value
    for cand, got in _pieces(batches, block):
        pair = cand[:, None] != block.ids[None, :]
        seed, bits = np.broadcast_to(block.ids, pair.shape)[pair], np.broadcast_to(block.bits, pair.shape)[pair]
        cols = [pa.array(seed), pa.array(np.broadcast_to(cand[:, None], pair.shape)[pair]), pa.array(bits, pa.int32())]
        for t in TRACKS:
            v = got[t][pair] if t in got else np.full(len(seed), np.nan)
            cols.append(pa.array(v, mask=np.isnan(v)))
        yield pa.RecordBatch.from_arrays(cols, ["seed", "cand", "live", *TRACKS])


def _best(batches, sent, track, k):
    block = sent.value
    for cand, got in _pieces(batches, block):
        score = np.round(got[track], 9)
        score[cand[:, None] == block.ids[None, :]] = np.nan
        for j in range(len(block.ids)):
            at = np.flatnonzero(~np.isnan(score[:, j]))
            at = at[np.lexsort((cand[at], -score[at, j]))[:k]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.ids[j])), pa.array(cand[at]), pa.array(got[track][at, j])], ["seed", "cand", "score"])


def _merged(batches):
    """Small batches as larger ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 10_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score_pairs(features: DataFrame, seeds: DataFrame, tracks: tuple[str, ...] = TRACKS, gated: dict[str, bool] | None = None) -> DataFrame:
    """(seed, cand, live, tfidf, semantic, authors, numerics, image) of every seed with every other row.

    live has a bit for each track the seed has; a score is null where seed or row has no vector. A track whose gate
    is shut is live for no seed.
    """
    spark = features.sparkSession
    ship(spark)
    out = None
    rows = features.select("book_id", *columns(tracks))
    for block in seed_blocks(features, seeds, tracks, gated or {}):
        sent = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda it, sent=sent: _all(it, sent), _PAIRS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _PAIRS) if out is None else out


_PAIRS = "seed long, cand long, live int, " + ", ".join(f"{t} double" for t in TRACKS)


def nearest(features: DataFrame, seeds: DataFrame, track: str, k: int = 10) -> DataFrame:
    """(seed, cand, score, rk): the k most similar rows of one track, ties by id. Tasks keep k rows for each seed."""
    spark = features.sparkSession
    ship(spark)
    out = None
    rows = features.select("book_id", *columns((track,)))
    for block in seed_blocks(features, seeds, (track,), {}):
        sent = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda it, sent=sent: _merged(_best(it, sent, track, k)), "seed long, cand long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "seed long, cand long, score double, rk int")
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "cand")
    return out.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def pair_scores(features: DataFrame, pairs: DataFrame, track: str) -> DataFrame:
    """pairs (seed, cand) plus score, for given pairs of a dense track; null without a vector."""
    v = features.select("book_id", F.col(track).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    both = pairs.join(v.select(F.col("book_id").alias("seed"), F.col("v").alias("a")), "seed", "left").join(v.select(F.col("book_id").alias("cand"), F.col("v").alias("b")), "cand", "left")
    size = F.sqrt(dot("a", "a") * dot("b", "b"))
    score = F.when(size > 0, dot("a", "b") / size).when(size == 0, F.lit(0.0))
    return both.select(*pairs.columns, score.alias("score"))
