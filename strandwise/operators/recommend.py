"""Recommendations for a table of seeds: scores, percentiles, weights, bias, re-ranking, re-sorting and caps in one chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..features.bundle import Tracks
from ..functions import text as T
from ..runtime import scratch
from . import blocks, rank, similarity


@dataclass(frozen=True)
class Options:
    """What recommend() does after the scores; the defaults are those of a plain query."""

    weights: dict[str, float] = field(default_factory=lambda: dict(rank.DEFAULT_WEIGHTS))
    k: int = 5
    mmr: bool = True
    mmr_lambda: float = 0.95
    mmr_space: str = "semantic"
    mmr_mode: str = "reference"
    year_bias: float = 0.0
    year_resort: bool = False
    caps: tuple[int, int] | None = (3, 1)
    backfill: bool = False
    image_min_coverage: float = 0.3
    per_candidate: bool = False


def gates(counts: dict[str, int], least: float = 0.3) -> dict[str, bool]:
    """The image track is used only if enough books have a cover (and, per seed, if the seed has one)."""
    return {"image": bool(counts["n"]) and counts["image"] / counts["n"] >= least}


def ranked_pairs(tracks: Tracks, seeds: DataFrame, least_cover: float = 0.3) -> DataFrame:
    """Scores and percentiles (p_<track>) of each seed with all other rows; the seed itself is never a candidate."""
    counts = tracks.counts()
    pairs = similarity.score_pairs(tracks.features, seeds, gated=gates(counts, least_cover))
    return rank.percentiles(pairs, counts)


def usable_spaces(space: str, counts: dict[str, int]) -> tuple[str, ...]:
    """The tracks named in "a|b" that have vectors."""
    return tuple(s for s in (x.strip() for x in space.split("|")) if s in similarity.TRACKS and counts.get(s))


def best(tracks: Tracks, seeds: DataFrame, settings: list[dict[str, float]], k: int, least_cover: float = 0.3, year_bias: float = 0.0, per_candidate: bool = False, mmr: str | None = None, lam: float = 0.95, space: str = "semantic", digits: int | None = None, plain: bool = False) -> DataFrame:
    """blocks.KEPT: the k best rows of each seed by each setting 1, 2, ... (or re-ranked by mmr, a mode of rank.mmr).

    plain: first those of all settings without re-ranking, then, numbered on, those with it.

    Pairs are never kept: seeds go block by block. Spaces for mmr are those of blocks.SPACES.
    """
    counts = tracks.counts()
    spaces = usable_spaces(space, counts) if mmr else ()
    weights = tuple(tuple(float(w.get(t, 0.0)) for t in similarity.TRACKS) for w in settings)
    ask = blocks.Ask(weights, k, year_bias, per_candidate, mmr if spaces else None, lam, spaces, digits, bool(spaces) and plain)
    out = blocks.best_rows(tracks.features, counts, seeds, ask, gates(counts, least_cover))
    if plain and mmr and not spaces:  # nothing to re-rank by
        out = out.unionByName(out.withColumn("g", F.col("g") + len(settings)))
    return out


def fused(ranked: DataFrame, tracks: Tracks, options: Options = Options()) -> DataFrame:
    """(seed, cand, fused) of all pairs."""
    value = rank.fused_column(options.weights, options.per_candidate)
    if options.year_bias > 0:
        ranked = rank.era_match(ranked, tracks.features)
        value = value + F.lit(options.year_bias) * F.col("era")
    return ranked.select("seed", "cand", value.alias("fused"))


def recommend(tracks: Tracks, seeds: DataFrame, options: Options = Options(), ranked: DataFrame | None = None) -> DataFrame:
    """(seed, rank, cand, fused) for seeds (seed): at most k rows each.

    A seed that isn't in the catalogue has no rows; seeds may repeat. Caps apply to the k picks, so fewer may be left;
    with backfill they apply to a longer list first.
    """
    o = options
    depth = 8 * o.k if o.backfill and o.caps else o.k
    spaces = usable_spaces(o.mmr_space, tracks.counts()) if o.mmr else ()
    in_blocks = ranked is None and set(spaces) <= set(blocks.SPACES)
    if ranked is None and not in_blocks:  # vectors of texts are too large to move with the scores
        ranked = ranked_pairs(tracks, seeds, o.image_min_coverage)
    if in_blocks:
        picks = best(tracks, seeds, [o.weights], depth, o.image_min_coverage, max(0.0, o.year_bias), o.per_candidate, o.mmr_mode if spaces else None, o.mmr_lambda, o.mmr_space)
        picks = picks.select("seed", "rk", "cand", "fused")
    elif spaces:
        rows = scratch(fused(ranked, tracks, o), "fused")
        vectors = tracks.features.select(F.col("book_id").alias("cand"), *similarity.columns(spaces))
        picks = rank.mmr(rows.withColumnRenamed("fused", "rel"), vectors, depth, o.mmr_lambda, o.mmr_mode)
        picks = picks.join(rows, ["seed", "cand"]).select("seed", F.col("rank").alias("rk"), "cand", "fused")
    elif o.per_candidate:
        rows = fused(ranked, tracks, o)
        order = rank.Window.partitionBy("seed").orderBy(F.desc(F.round("fused", 9)), "cand")
        picks = rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= depth)
    else:
        rows = rank.era_match(ranked, tracks.features) if o.year_bias > 0 else ranked
        picks = rank.top_fused(rows, [o.weights], depth, o.year_bias).drop("g")
    if o.year_resort:
        picks = rank.year_resort(picks, tracks.features)
    if o.caps:
        picks = scratch(picks, "picks")
        kept = rank.enforce_caps(picks.withColumnRenamed("rk", "rank").join(cap_keys(tracks.books), "cand", "left"), *o.caps)
        picks = kept.join(picks.select("seed", "cand", "fused"), ["seed", "cand"]).withColumnRenamed("rank", "rk")
        order = rank.Window.partitionBy("seed").orderBy("rk")
        picks = picks.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= o.k)
    return picks.select("seed", F.col("rk").alias("rank"), "cand", "fused")


def cap_keys(books: DataFrame) -> DataFrame:
    """(cand, author, desc_hash): what caps count."""
    names = F.col("author_list") if "author_list" in books.columns else T.author_list(F.col("authors"))
    main = F.lower(F.trim(F.get(names, F.lit(0))))
    digest = F.col("desc_hash") if "desc_hash" in books.columns else T.text_hash(F.col("description"))
    return books.select(F.col("book_id").alias("cand"), F.when(main != "", main).alias("author"), digest.alias("desc_hash"))


def recommend_by_id(tracks: Tracks, book_id: int, options: Options = Options()) -> dict:
    """Picks of one seed with their percentiles; KeyError if the id is unknown."""
    spark = tracks.features.sparkSession
    if tracks.features.where(F.col("book_id") == book_id).isEmpty():
        raise KeyError(f"book_id {book_id} not found")
    ranked = scratch(ranked_pairs(tracks, spark.createDataFrame([(book_id,)], "seed long"), options.image_min_coverage), "ranked")
    picks = recommend(tracks, spark.createDataFrame([(book_id,)], "seed long"), options, ranked)
    live = rank.live_tracks(ranked.select("live").first()[0] if not ranked.isEmpty() else 0)
    rows = picks.join(ranked.select("cand", *[f"p_{t}" for t in live]), "cand").orderBy("rank").collect()
    return {"seed_book_id": book_id, "picked": [{"book_id": r.cand, "rank": r["rank"]} for r in rows], "modality_percentiles": {t: [r[f"p_{t}"] for r in rows] for t in live}}


def serve(tracks: Tracks, seeds: DataFrame, weights: dict[str, float], year_bias: float = 0.02, mmr: bool = False, space: str = "tfidf|authors") -> DataFrame:
    """The final list: five rows with year bias, re-sorting by year and caps."""
    return recommend(tracks, seeds, Options(weights=weights, k=5, mmr=mmr, mmr_space=space, year_bias=year_bias, year_resort=True, caps=(3, 1)))


def contributions(picks: DataFrame, ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """picks (seed, rank, cand) with <track>_part: percentile times the caller's weight, and their sum."""
    parts = [(F.when(F.col("live").bitwiseAND(1 << similarity.TRACKS.index(t)) != 0, F.col(f"p_{t}") * F.lit(weights.get(t, 0.0))).otherwise(F.lit(0.0))).alias(f"{t}_part") for t in similarity.TRACKS]
    out = picks.select("seed", "rank", "cand").join(ranked, ["seed", "cand"]).select("seed", "rank", "cand", *parts)
    return out.withColumn("fused_sum", sum((F.col(f"{t}_part") for t in similarity.TRACKS), F.lit(0.0)))


def numeric_contributions(picks: DataFrame, features: DataFrame) -> DataFrame:
    """(seed, cand, feature, contrib): what each numeric feature adds to the cosine of seed and pick."""
    from ..features.metadata import FEATURES

    v = lambda key, name: features.select(F.col("book_id").alias(key), F.col("numerics").alias(name))
    both = picks.select("seed", "cand").join(v("seed", "a"), "seed").join(v("cand", "b"), "cand")
    parts = F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("f"), F.zip_with("a", "b", lambda x, y: x * y).alias("c"))
    return both.select("seed", "cand", F.explode(parts).alias("x")).select("seed", "cand", F.col("x.f").alias("feature"), F.col("x.c").alias("contrib"))


def nearest_table(tracks: Tracks, seeds: DataFrame, track: str, k: int = 10) -> DataFrame:
    """The k nearest of one track with title, whether an author is shared, and the differences of year and rating."""
    near = similarity.nearest(tracks.features, seeds, track, k)
    b = tracks.books
    names = F.col("author_list") if "author_list" in b.columns else T.author_list(F.col("authors"))
    rows = b.select("book_id", "title", names.alias("names"), F.col("original_publication_year").alias("year"), F.col("average_rating").alias("rating"))
    one, two = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in ("s", "c"))
    both = near.join(one, near["seed"] == one["book_id_s"]).join(two, near["cand"] == two["book_id_c"])
    return both.select(
        "seed", "cand", "rk", F.col("title_c").alias("title"), F.col("score").alias("cosine"), F.arrays_overlap("names_s", "names_c").alias("shared_author"),
        (F.col("year_c") - F.col("year_s")).alias("d_year"), (F.col("rating_c") - F.col("rating_s")).alias("d_rating"),
    )
