"""Genres, evaluation of picks, weight search and selection."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..features.bundle import Tracks
from ..runtime import scratch
from . import blocks, rank, recommend, similarity
from .taxonomy import TAXONOMY


def taxonomy(spark: SparkSession) -> DataFrame:
    """(p, category, needle): a genre belongs to the first category with a needle that occurs in it."""
    return spark.createDataFrame([(p, c, n) for p, (c, needles) in enumerate(TAXONOMY.items()) for n in needles], "p int, category string, needle string")


def coarse(genre: Column) -> Column:
    """Category of one genre: the first whose needle occurs in it, else other; null for a blank one."""
    g = F.lower(F.trim(genre))
    out = F.lit("other")
    for category, needles in reversed(TAXONOMY.items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(g, F.lit(n))
        out = F.when(hit, F.lit(category)).otherwise(out)
    return F.when(g != "", out)


def coarse_genres(cache: DataFrame) -> DataFrame:
    """(book_id, combo): the sorted categories of a cache (book_id, genres array); "other" if there are none.

    Categories are looked up once per distinct genre, not once per book.
    """
    one = cache.select("book_id", F.explode_outer("genres").alias("g"))
    known = one.select("g").where("g IS NOT NULL").distinct().withColumn("c", coarse(F.col("g")))
    got = one.join(known, "g", "left").groupBy("book_id").agg(F.array_sort(F.collect_set("c")).alias("combo"))
    return got.select("book_id", F.when(F.size("combo") > 0, F.col("combo")).otherwise(F.array(F.lit("other"))).alias("combo"))


def igf_weights(combos: DataFrame, mode: str = "combo") -> DataFrame:
    """(key, n, igf): inverse frequency of combinations (or of single categories, mode "genre"), the largest is 1."""
    keys = combos.select(F.array_join("combo", "|").alias("key")) if mode == "combo" else combos.select(F.explode("combo").alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))  # at most as many rows as there are combinations
    total = counts.agg(F.sum("n"), F.min("n")).first()
    if total[0] is None:
        return counts.withColumn("igf", F.lit(None).cast("double"))
    top = (total[0] + 1) / (total[1] + 1)
    return counts.withColumn("igf", F.lit(total[0] + 1.0) / (F.col("n") + 1) / F.lit(top))


def genre_hits(picks: DataFrame, combos: DataFrame, igf: DataFrame | None, mode: str = "combo") -> DataFrame:
    """picks (..., seed, cand) plus genre: 0 without a common category, else the weight of the candidate's genres.

    Books outside the cache count as "other". A combination without a weight weighs 1; without any weights a hit is 1.
    """
    other = F.array(F.lit("other"))
    side = lambda key, name: combos.select(F.col("book_id").alias(key), F.col("combo").alias(name))
    both = picks.join(side("seed", "a"), "seed", "left").join(side("cand", "b"), "cand", "left")
    both = both.withColumns({"a": F.coalesce("a", other), "b": F.coalesce("b", other)})
    hit = F.arrays_overlap("a", "b")
    if igf is None:
        return both.withColumn("genre", F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))).drop("a", "b")
    if mode == "combo":
        both = both.withColumn("key", F.array_join("b", "|")).join(igf.select("key", "igf"), "key", "left").drop("key")
        return both.withColumn("genre", F.when(hit, F.coalesce("igf", F.lit(1.0))).otherwise(F.lit(0.0))).drop("a", "b", "igf")
    table = {r.key: r.igf for r in igf.collect()}  # a category each, a few dozen at most
    shared = F.array_intersect("a", "b")
    lookup = F.create_map(*[F.lit(v) for pair in table.items() for v in pair]) if table else F.create_map().cast("map<string,double>")
    mean = F.aggregate(F.transform(shared, lambda x: F.coalesce(F.try_element_at(lookup, x), F.lit(1.0))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(shared), F.lit(1))
    return both.withColumn("genre", F.when(hit, mean).otherwise(F.lit(0.0))).drop("a", "b")


def genre_at_k(picks: DataFrame, combos: DataFrame, igf: DataFrame | None = None, mode: str = "combo", by: tuple[str, ...] = ("seed",)) -> DataFrame:
    return genre_hits(picks, combos, igf, mode).groupBy(*by).agg(F.avg("genre").alias("genre_at_k"))


def yearflag_at_k(picks: DataFrame, features: DataFrame, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    return rank.era_match(picks, features).groupBy(*by).agg(F.avg("era").alias("yearflag"))


def rating_drift(picks: DataFrame, features: DataFrame, band: float = 0.5) -> DataFrame:
    """(seed, drift): share of picks whose rating is further than `band` from the seed's; unknown ratings are left out."""
    r = lambda key, name: features.select(F.col("book_id").alias(key), F.col("rating").alias(name))
    both = picks.join(r("seed", "r0"), "seed").join(r("cand", "r1"), "cand")
    return both.groupBy("seed").agg(F.coalesce(F.avg((F.abs(F.col("r1") - F.col("r0")) > band).cast("double")), F.lit(0.0)).alias("drift"))


def weight_grid() -> list[dict[str, float]]:
    """The 16 settings of the coarse search."""
    # The steps of each track.
    steps = {"tfidf": (0.2, 0.4), "semantic": (0.3, 0.5), "authors": (0.1, 0.3), "numerics": (0.05, 0.15), "image": (0.05,)}
    return [dict(zip(steps, w, strict=True)) for w in itertools.product(*steps.values())]


def fine_sweep(best: dict[str, float], step: float = 0.05) -> list[dict[str, float]]:
    """Settings around the best one: each weight a step down, kept or a step up, normalised, alike ones once."""
    out: dict[tuple, dict[str, float]] = {}
    for deltas in itertools.product((-step, 0.0, step), repeat=len(similarity.TRACKS)):
        w = {t: max(0.0, best.get(t, 0.0) + d) for t, d in zip(similarity.TRACKS, deltas, strict=True)}
        if total := sum(w.values()):
            w = {t: v / total for t, v in w.items()}
            out.setdefault(tuple(round(v, 3) for v in w.values()), w)
    return list(out.values())


def evaluate(
    tracks: Tracks, seeds: DataFrame, settings: list[dict[str, float]], combos: DataFrame, igf: DataFrame | None, k: int = 10, mmr: bool = False, lam: float = 0.95, space: str = "semantic",
    genre_weight: float = 0.8, year_weight: float = 0.2, ranked: DataFrame | None = None, plain: bool = False,
) -> DataFrame:
    """(g, genre, yearflag, score): means over the seeds for each setting 1, 2, ... Scores and percentiles are worked out once.

    plain: first those of all settings without re-ranking, then, numbered on, those with it.
    """
    hits = seed_scores(tracks, seeds, settings, combos, igf, k, mmr, lam, space, ranked, plain)
    means = hits.groupBy("g").agg(F.avg("genre").alias("genre"), F.avg("yearflag").alias("yearflag"))
    return means.withColumn("score", F.lit(genre_weight) * F.col("genre") + F.lit(year_weight) * F.col("yearflag"))


def seed_scores(tracks, seeds, settings, combos, igf, k=10, mmr=False, lam=0.95, space="semantic", ranked=None, plain=False) -> DataFrame:
    """(g, seed, genre, yearflag) of each setting and seed."""
    if ranked is None and set(recommend.usable_spaces(space, tracks.counts()) if mmr else ()) <= set(blocks.SPACES):
        picks = recommend.best(tracks, seeds, settings, k, mmr="reference" if mmr else None, lam=lam, space=space, plain=plain and mmr).select("g", "seed", "cand")
    elif mmr:
        ranked = recommend.ranked_pairs(tracks, seeds) if ranked is None else ranked
        ranked = scratch(ranked, "ranked")
        picks = rank.top_fused(ranked, settings, k).select("g", "seed", "cand") if plain else None
        for g, w in enumerate(settings, 1 + len(settings) * plain):
            one = recommend.recommend(tracks, seeds, recommend.Options(weights=w, k=k, mmr_lambda=lam, mmr_space=space, caps=None), ranked)
            one = one.select(F.lit(g).alias("g"), "seed", "cand")
            picks = one if picks is None else picks.unionByName(one)
    else:
        picks = rank.top_fused(ranked, settings, k).select("g", "seed", "cand")
    hits = rank.era_match(genre_hits(picks, combos, igf), tracks.features)
    return hits.groupBy("g", "seed").agg(F.avg("genre").alias("genre"), F.avg("era").alias("yearflag"))


def select_weights(means: DataFrame, settings: list[dict[str, float]]) -> tuple[dict[str, float], float]:
    """The setting with the best score (the first of ties), and that score."""
    best = means.orderBy(F.desc(F.round("score", 9)), "g").first()
    return settings[best.g - 1], best.score


def test_seeds(books: DataFrame, share: float = 0.5, most: int = 100, seed: int = 42) -> DataFrame:
    """At most `most` seeds, at most that share of the books, in an order drawn by hash."""
    n = min(int(books.count() * share), most)
    return books.select(F.col("book_id").alias("seed")).orderBy(draw(seed, "seed"), "seed").limit(n)


def draw(salt: int | str, key: str) -> Column:
    """A pseudo-random order that every engine with MD5 can repeat."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))


def ablations(weights: dict[str, float]) -> dict[str, dict[str, float]]:
    """The setting, the setting without each track (the rest renormalised), and each track alone."""
    drop = {f"no_{t}": rank.renormalised({**weights, t: 0.0}, [x for x in similarity.TRACKS if x != t]) for t in similarity.TRACKS}
    return {"fusion": weights, **drop, **{t: {t: 1.0} for t in similarity.TRACKS}}


def seed_winners(scores: DataFrame, names: list[str], genre_weight: float = 0.7, year_weight: float = 0.3) -> DataFrame:
    """(seed, winner, combo): the setting with the best mix of genre and era for each seed; ties by name."""
    label = F.element_at(F.array(*map(F.lit, names)), F.col("g"))
    mix = F.lit(genre_weight) * F.coalesce("genre", F.lit(0.0)) + F.lit(year_weight) * F.coalesce("yearflag", F.lit(0.0))
    rows = scores.select("seed", label.alias("winner"), mix.alias("combo"))
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("combo", 9)), "winner")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def group_report(scores: DataFrame, groups: DataFrame, least: float = 0.10, ratio: float = 2.0) -> DataFrame:
    """(seed_group, n, genre, yearflag, gap_wide): means per group of seeds, and whether the two groups lie far apart."""
    rows = scores.join(groups, "seed").groupBy("seed_group").agg(F.count("*").alias("n"), F.avg("genre").alias("genre"), F.avg("yearflag").alias("yearflag"))
    ends = rows.agg(F.min("genre").alias("lo"), F.max("genre").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("seed_group", "n", "genre", "yearflag", ((F.col("hi") - F.col("lo") >= least) | (F.col("hi") >= F.lit(ratio) * F.col("lo"))).alias("gap_wide"))
