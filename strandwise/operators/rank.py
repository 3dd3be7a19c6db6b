"""Ranking: percentiles, weights, blending, caps and maximal marginal relevance, for many seeds at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch, ship
from .order import running
from .similarity import TRACKS, dense_rows, sparse_rows

# The weights of the tracks unless others are given.
DEFAULT_WEIGHTS = {"tfidf": 0.3, "semantic": 0.4, "authors": 0.2, "numerics": 0.1, "image": 0.0}
#: Rows per seed beyond which a seed's rows are ranked by ranges in several tasks instead of in one; the ranks are the same.
SPREAD = 2_000_000


def rank_percentile(scores: DataFrame) -> DataFrame:
    """(seed, track, cand, score) plus pct = ascending rank / (rows + 1) within seed and track, ties by cand.

    Scores that are null or NaN have no rank and get 0.
    """
    valid = F.col("score").isNotNull() & ~F.isnan("score")
    order = Window.partitionBy("seed", "track").orderBy(F.desc(valid), F.round("score", 9), "cand")
    n = scores.where(valid).groupBy("seed", "track").agg(F.count("*").alias("n"))
    ranked = scores.withColumn("r", F.row_number().over(order)).join(n, ["seed", "track"], "left")
    return ranked.withColumn("pct", F.when(valid, F.col("r") / (F.col("n") + 1)).otherwise(F.lit(0.0))).drop("r", "n")


def percentiles(pairs: DataFrame, counts: dict[str, int], spread: bool | None = None) -> DataFrame:
    """pairs plus p_<track>: rank / (ranked rows + 1), 0 where there is no score.

    counts: rows with a vector per track, and n. A seed that has a track is compared with all others that have it,
    so the number of ranked rows + 1 is the track's count. The rows of a seed move once, and each track is a sort in
    place; with very many rows per seed (`spread`) each track is ranked over ranges in several tasks.
    """
    spread = counts["n"] > SPREAD if spread is None else spread
    if not spread:
        out = pairs
        for t in TRACKS:
            if counts.get(t):
                order = Window.partitionBy("seed").orderBy(F.asc_nulls_last(F.round(t, 9)), "cand")
                out = out.withColumn(f"p_{t}", F.when(F.col(t).isNotNull(), F.row_number().over(order) / F.lit(float(counts[t]))).otherwise(F.lit(0.0)))
            else:
                out = out.withColumn(f"p_{t}", F.lit(0.0))
        return out
    out = pairs = scratch(pairs, "pairs")
    for t in TRACKS:
        if not counts.get(t):
            out = out.withColumn(f"p_{t}", F.lit(0.0))
            continue
        rows = pairs.where(F.col(t).isNotNull()).select("seed", "cand", F.round(t, 9).alias("s"))
        got = running(rows, ["s", "cand"], F.lit(1).cast("long"), ["seed"]).select("seed", "cand", ((F.col("before") + 1) / F.lit(float(counts[t]))).alias(f"p_{t}"))
        out = out.join(got, ["seed", "cand"], "left").withColumn(f"p_{t}", F.coalesce(f"p_{t}", F.lit(0.0)))
    return out


def renormalised(weights: dict[str, float], available: list[str]) -> dict[str, float]:
    """Weights of the available tracks, negatives as 0, summing to 1; uniform if all are 0."""
    kept = {t: max(0.0, weights.get(t, 0.0)) for t in available}
    total = sum(kept.values())
    return {t: (v / total if total else 1 / len(kept)) for t, v in kept.items()}


def live_tracks(bits: int) -> list[str]:
    return [t for k, t in enumerate(TRACKS) if bits >> k & 1]


def fused_column(weights: dict[str, float], per_candidate: bool = False):
    """Sum of percentile times weight, the weights renormalised over the tracks the seed has.

    per_candidate renormalises over the tracks that seed and candidate both have.
    """
    share = {}
    for t in TRACKS:
        has = F.col("live").bitwiseAND(1 << TRACKS.index(t)) != 0
        share[t] = has & F.col(t).isNotNull() if per_candidate else has
    plus = {t: max(0.0, weights.get(t, 0.0)) for t in TRACKS}
    total = sum((F.when(share[t], F.lit(plus[t])).otherwise(F.lit(0.0)) for t in TRACKS), F.lit(0.0))
    n = sum((share[t].cast("int") for t in TRACKS), F.lit(0))
    by_weight = sum((F.when(share[t], F.col(f"p_{t}") * F.lit(plus[t])).otherwise(F.lit(0.0)) for t in TRACKS), F.lit(0.0))
    even = sum((F.when(share[t], F.col(f"p_{t}")).otherwise(F.lit(0.0)) for t in TRACKS), F.lit(0.0))
    return F.when(total > 0, by_weight / F.when(total > 0, total)).when(n > 0, even / F.when(n > 0, n)).otherwise(F.lit(0.0))


def _partial(batches, weights: np.ndarray, k: int, bias: float):
    """The k best rows of each seed and weight set among this task's rows."""
    held: dict = {}
    live_w: dict = {}

    def share(bits):
        if bits not in live_w:
            on = np.array([bits >> j & 1 for j in range(len(TRACKS))], float)
            w = np.maximum(weights, 0) * on
            total = w.sum(axis=1, keepdims=True)
            live_w[bits] = np.where(total > 0, w / np.where(total > 0, total, 1), on / max(1, on.sum()))
        return live_w[bits]

    for b in batches:
        seed, cand, live = (b.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "cand", "live"))
        p = np.stack([b.column(f"p_{t}").to_numpy(zero_copy_only=False) for t in TRACKS])
        plus = bias * b.column("era").to_numpy(zero_copy_only=False) if bias else 0.0
        for s in np.unique(seed):
            at = np.flatnonzero(seed == s)
            f = share(int(live[at[0]])) @ p[:, at] + (plus[at] if bias else 0.0)
            for g in range(len(f)):
                c, v = cand[at], f[g]
                if (s, g) in held:
                    c, v = np.r_[held[s, g][0], c], np.r_[held[s, g][1], v]
                if len(c) > 4 * k:
                    low = np.partition(np.round(v, 9), len(v) - k)[len(v) - k]
                    keep = np.round(v, 9) >= low
                    c, v = c[keep], v[keep]
                best = np.lexsort((c, -np.round(v, 9)))[:k]
                held[s, g] = (c[best], v[best])
    for (s, g), (c, v) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), g + 1, np.int32)), pa.array(np.full(len(c), s)), pa.array(c), pa.array(v)], ["g", "seed", "cand", "fused"])


def top_fused(ranked: DataFrame, settings: list[dict[str, float]], k: int, year_bias: float = 0.0) -> DataFrame:
    """(g, seed, cand, fused, rk): the k best rows of each seed for each of the weight sets 1, 2, ...

    ranked has live, p_<track> and, with a year bias, era (1 where seed and row share both era flags). Percentiles are
    worked out once for all sets; a task keeps k rows per seed and set, and only those move.
    """
    ship(ranked.sparkSession)
    w = np.array([[s.get(t, 0.0) for t in TRACKS] for s in settings], float)
    cols = ["seed", "cand", "live", *[f"p_{t}" for t in TRACKS], *(["era"] if year_bias else [])]
    part = ranked.select(*cols).mapInArrow(lambda it: _partial(it, w, k, year_bias), "g int, seed long, cand long, fused double")
    order = Window.partitionBy("g", "seed").orderBy(F.desc(F.round("fused", 9)), "cand")
    return part.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def era_match(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs (seed, cand, ...) plus era: 1 where both era flags are equal, else 0."""
    flags = lambda key, a, b: features.select(F.col("book_id").alias(key), F.col("modern_flag").alias(a), F.col("pre_1900_flag").alias(b))
    both = pairs.join(flags("seed", "m0", "o0"), "seed").join(flags("cand", "m1", "o1"), "cand")
    return both.withColumn("era", ((F.col("m0") == F.col("m1")) & (F.col("o0") == F.col("o1"))).cast("int")).drop("m0", "o0", "m1", "o1")


def year_resort(picks: DataFrame, features: DataFrame) -> DataFrame:
    """Picks (seed, cand, rk) ranked anew by the distance of the years, unknown ones last, then by the old rank."""
    year = lambda key, name: features.select(F.col("book_id").alias(key), F.col("year").alias(name))
    far = picks.join(year("seed", "y0"), "seed").join(year("cand", "y1"), "cand").withColumn("far", F.abs(F.col("y1") - F.col("y0")))
    order = Window.partitionBy("seed").orderBy(F.asc_nulls_last("far"), "rk")
    return far.withColumn("rk", F.row_number().over(order)).drop("y0", "y1", "far")


def enforce_caps(ranked: DataFrame, author_cap: int = 3, desc_cap: int = 1) -> DataFrame:
    """(seed, rank, cand, author, desc_hash): greedy by rank, a row is skipped if its author or description is used up.

    Skipped rows don't count; a null author has no cap. The rows of a seed are a list of picks (a few), kept as one
    array.
    """
    cast = ranked.select("seed", F.col("rank").cast("int").alias("rank"), F.col("cand").cast("long").alias("cand"), F.col("author").cast("string").alias("author"), F.col("desc_hash").cast("string").alias("desc_hash"))
    rows = cast.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "cand", "author", "desc_hash"))).alias("items"))
    none = F.array().cast("array<struct<rank:int,cand:bigint,author:string,desc_hash:string>>")

    def step(kept, x):
        by_author = F.size(F.filter(kept, lambda y: y["author"].eqNullSafe(x["author"])))
        by_desc = F.size(F.filter(kept, lambda y: y["desc_hash"].eqNullSafe(x["desc_hash"])))
        full = (x["author"].isNotNull() & (by_author >= author_cap)) | (by_desc >= desc_cap)
        return F.when(full, kept).otherwise(F.array_append(kept, x))

    out = rows.select("seed", F.explode(F.aggregate("items", none, step)).alias("x"))
    return out.select("seed", "x.rank", "x.cand")


def mmr_bound(rel: DataFrame, k: int, lam: float, spread: float = 2.0) -> DataFrame:
    """Rows of (seed, cand, rel) that can still win: rel at least the k-th best minus (1 - lam) / lam * spread."""
    order = Window.partitionBy("seed").orderBy(F.desc("rel"), "cand")
    kth = rel.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("seed").agg(F.min("rel").alias("kth"))
    return rel.join(kth, "seed").where(F.col("rel") >= F.col("kth") - (1 - lam) / lam * spread).drop("kth")


def _sparse_dots(batch, name: str) -> np.ndarray:
    """Dot products of each row's sparse vector and its pick's."""
    (ra, ia, wa, ta), (rb, ib, wb, tb) = (sparse_rows(batch.column(f"{p}{name}_ids"), batch.column(f"{p}{name}_w")) for p in ("v_", "q_"))
    key = lambda row, ids: ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, at, to = np.intersect1d(key(ra, ia), key(rb, ib), assume_unique=True, return_indices=True)
    out = np.bincount(ra[at], weights=wa[at] * wb[to], minlength=batch.num_rows).astype(float)
    out[~(ta & tb)] = np.nan
    return out


def _dots(batches, spaces: list[str]):
    """Adds to each row the similarity of its vectors to those of the pick, the largest over the spaces."""
    for b in batches:
        best = np.full(b.num_rows, np.nan)
        for name in spaces:
            if f"v_{name}_ids" in b.schema.names:
                got = _sparse_dots(b, name)
            else:
                (p, x), (q, y) = dense_rows(b.column(f"v_{name}")), dense_rows(b.column(f"q_{name}"))
                both = x & y
                got = np.full(b.num_rows, np.nan)
                if both.any():
                    got[both] = (p[both] * q[both]).sum(axis=1)
            best = np.fmax(best, got)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("seed", "cand", "rel", "worst")), pa.array(best, mask=np.isnan(best))], ["seed", "cand", "rel", "worst", "sim"])


def mmr(rel: DataFrame, vectors: DataFrame, k: int = 10, lam: float = 0.95, mode: str = "reference") -> DataFrame:
    """(seed, rank, cand): greedy re-ranking of (seed, cand, rel) with vectors (cand, and a column or more).

    A list column is a dense vector, a pair <name>_ids and <name>_w a sparse one. mode "reference" subtracts the
    largest dissimilarity to what is picked (it favours similar items), "standard" the largest similarity; with
    several vectors the largest similarity over the spaces counts, and a candidate without any has no penalty.

    Each of the k rounds is one distributed pass: rows keep their penalty so far, the best row of each seed is picked
    by an aggregate, and only the picks' vectors move to the rows. No seed's rows are ever gathered. Rows that can't
    win are left out first.
    """
    ship(rel.sparkSession)
    cols = [c for c in vectors.columns if c != "cand"]
    spaces = list(dict.fromkeys(re.sub("_(ids|w)$", "", c) for c in cols))
    own = vectors.select("cand", *[F.col(c).alias(f"v_{c}") for c in cols])
    theirs = vectors.select(F.col("cand").alias("pick"), *[F.col(c).alias(f"q_{c}") for c in cols])
    rows = mmr_bound(rel.select("seed", "cand", "rel"), k, lam).withColumn("worst", F.lit(0.0))
    rows = scratch(rows, "mmr")
    picks = None
    for turn in range(k):
        value = F.round(F.lit(lam) * F.col("rel") - F.lit(1 - lam) * F.col("worst"), 12)
        best = rows.groupBy("seed").agg(F.max(F.struct(value.alias("value"), (-F.col("cand")).alias("o"))).alias("b"))
        best = scratch(best.select("seed", F.lit(turn + 1).alias("rank"), (-F.col("b.o")).alias("cand")), "picks")
        picks = best if picks is None else picks.unionByName(best)
        if turn == k - 1:
            break
        pick = best.select("seed", F.col("cand").alias("pick")).join(theirs, "pick", "left")
        rest = rows.join(pick, "seed").where("cand != pick").join(own, "cand", "left")
        rest = rest.select("seed", "cand", "rel", "worst", *[f"v_{c}" for c in cols], *[f"q_{c}" for c in cols])
        seen = rest.mapInArrow(lambda it: _dots(it, spaces), "seed long, cand long, rel double, worst double, sim double")
        penalty = 1 - F.col("sim") if mode == "reference" else F.col("sim")
        rows = scratch(seen.select("seed", "cand", "rel", F.greatest("worst", F.coalesce(penalty, F.lit(0.0))).alias("worst")), "mmr")
        if rows.isEmpty():
            break
    return picks
