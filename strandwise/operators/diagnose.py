"""Diagnostics of tracks: agreement, stability, separation, diversity, norms, and the scorecard that weighs tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..features.bundle import Tracks, column
from ..functions import text as T
from ..runtime import scratch, ship
from . import similarity
from .evaluate import draw
from .order import quantiles

# The pairs of tracks that are compared, the limits of agreement that count as good, and the baseline weights.
PAIRS = [("semantic", "tfidf"), ("semantic", "authors"), ("semantic", "numerics"), ("tfidf", "authors"), ("tfidf", "numerics"), ("authors", "numerics"), ("semantic", "image")]
JACCARD_GOOD, TAU_GOOD = (0.25, 0.8), (0.15, 0.7)
BASELINE = {"semantic": 0.45, "tfidf": 0.25, "authors": 0.10, "numerics": 0.10, "image": 0.10}


def neighbour_lists(tracks: Tracks, seeds: DataFrame, k: int = 100) -> DataFrame:
    """(track, seed, cand, rk): the k nearest of each seed in every track that has vectors."""
    out, counts = None, tracks.counts()
    for t in similarity.TRACKS:
        if counts[t]:
            one = similarity.nearest(tracks.features, seeds, t, k).select(F.lit(t).alias("track"), "seed", "cand", "rk")
            out = one if out is None else out.unionByName(one)
    return out


def seed_pairs(lists: DataFrame) -> DataFrame:
    """(seed, t1, t2): for each seed the pairs of tracks that both have a list for it."""
    have = lists.select("seed", "track").distinct()
    pairs = lists.sparkSession.createDataFrame(PAIRS, "t1 string, t2 string")
    one, two = (have.select("seed", F.col("track").alias(n)) for n in ("t1", "t2"))
    return one.join(F.broadcast(pairs), "t1").join(two, ["seed", "t2"]).select("seed", "t1", "t2")


def _shared(lists: DataFrame, k: int) -> DataFrame:
    top = lists.where(F.col("rk") <= k)
    one, two = (top.select("seed", "cand", F.col("track").alias(t), F.col("rk").alias(r)) for t, r in (("t1", "r1"), ("t2", "r2")))
    return one.join(two, ["seed", "cand"]).join(F.broadcast(lists.sparkSession.createDataFrame(PAIRS, "t1 string, t2 string")), ["t1", "t2"])


def jaccard_at_k(lists: DataFrame, k: int = 10) -> DataFrame:
    """(seed, t1, t2, jaccard): common ones of both lists' first k, divided by k; 0 if there are none."""
    n = _shared(lists, k).groupBy("seed", "t1", "t2").agg(F.count("*").alias("n"))
    return seed_pairs(lists).join(n, ["seed", "t1", "t2"], "left").select("seed", "t1", "t2", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("jaccard"))


def kendall_tau(lists: DataFrame, k: int = 10) -> DataFrame:
    """(seed, t1, t2, tau) over the common ones of both lists' first k; 0 if there are fewer than two.

    The common ones of a seed and pair are at most k, so they are compared within one array.
    """
    both = _shared(lists, k).groupBy("seed", "t1", "t2").agg(F.transform(F.array_sort(F.collect_list(F.struct("r1", "r2"))), lambda x: x["r2"]).alias("r"))
    later = lambda x, i: F.size(F.filter(F.slice("r", i + 2, F.size("r")), lambda y: y < x))
    inversions = F.aggregate(F.transform("r", later), F.lit(0), lambda s, x: s + x)
    pairs = F.size("r") * (F.size("r") - 1) / 2
    both = both.select("seed", "t1", "t2", F.when(pairs > 0, 1 - 2 * inversions / F.when(pairs > 0, pairs)).otherwise(F.lit(0.0)).alias("tau"))
    return seed_pairs(lists).join(both, ["seed", "t1", "t2"], "left").select("seed", "t1", "t2", F.coalesce("tau", F.lit(0.0)).alias("tau"))


def agreement(lists: DataFrame, k: int = 10) -> DataFrame:
    """(pair, jaccard, tau): means over the seeds."""
    lists = scratch(lists, "lists")
    both = jaccard_at_k(lists, k).join(kendall_tau(lists, k), ["seed", "t1", "t2"])
    return both.groupBy(F.concat_ws("_", "t1", "t2").alias("pair")).agg(F.avg("jaccard").alias("jaccard"), F.avg("tau").alias("tau"))


def verdict(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value < limits[0], "low").when(value > limits[1], "very high").otherwise("good")


def agreement_messages(table: DataFrame) -> DataFrame:
    """(pair, jaccard_is, tau_is, note): what the agreement of two tracks says about fusing them."""
    j, t = verdict(F.col("jaccard"), JACCARD_GOOD), verdict(F.col("tau"), TAU_GOOD)
    rows = table.select("pair", j.alias("jaccard_is"), t.alias("tau_is"))
    note = F.when((F.col("jaccard_is") == "good") & (F.col("tau_is") == "good"), "good agreement").when(
        (F.col("jaccard_is") == "very high") | (F.col("tau_is") == "very high"), "redundant: adjust fusion weights").otherwise("low agreement: adjust fusion weights or thresholds")
    return rows.withColumn("note", note)


def uniqueness(table: DataFrame, anchor: str = "semantic") -> DataFrame:
    """(track, uniqueness): 1 - jaccard of the pairs that begin with the anchor."""
    return table.where(F.col("pair").startswith(f"{anchor}_")).select(F.substring("pair", len(anchor) + 2, 100).alias("track"), (1 - F.col("jaccard")).alias("uniqueness"))


def stability(features: DataFrame, seeds: DataFrame, track: str, trials: int = 3, share: float = 0.5, k: int = 10) -> DataFrame:
    """(trial, stability): mean overlap of each seed's k nearest with those within a random share of the rows.

    Rows, seeds among them, are drawn by the MD5 of trial and id.
    """
    limit = f"{int(share * 16**8):08x}" if share < 1 else "g"
    base = scratch(similarity.nearest(features, seeds, track, k).select("seed", "cand"), "nearest")
    out = None
    for trial in range(1, trials + 1):
        inside = lambda key, trial=trial: F.substring(draw(trial, key), 1, 8) < limit
        part = similarity.nearest(features.where(inside("book_id")), seeds.where(inside("seed")), track, k).select("seed", "cand", F.lit(1).alias("hit"))
        seen = part.select("seed").distinct()
        hits = base.join(seen, "seed").join(part, ["seed", "cand"], "left").groupBy("seed").agg((F.count("hit") / F.lit(float(k))).alias("j"))
        one = hits.agg(F.lit(trial).alias("trial"), F.coalesce(F.avg("j"), F.lit(0.0)).alias("stability"))
        out = one if out is None else out.unionByName(one)
    return out


def main_author(books: DataFrame) -> Column:
    names = F.col("author_list") if "author_list" in books.columns else T.author_list(F.col("authors"))
    return F.lower(F.trim(F.get(names, F.lit(0))))


def group_keys(books: DataFrame) -> DataFrame:
    """(book_id, kind, k): the groups a book belongs to, by main author and by description."""
    digest = F.col("desc_hash") if "desc_hash" in books.columns else T.text_hash(F.col("description"))
    rows = books.select("book_id", main_author(books).alias("a"), digest.alias("d"))
    return rows.select("book_id", F.lit("a").alias("kind"), F.col("a").alias("k")).where("a <> ''").unionByName(rows.select("book_id", F.lit("d").alias("kind"), F.col("d").alias("k")))


def positive_sets(books: DataFrame, seeds: DataFrame, k: int = 30) -> DataFrame:
    """(seed, cand): the first k others by id with the seed's main author or description.

    The first k others of a group are among its first k + 1 members, so groups are cut before they are joined.
    """
    keys = group_keys(books)
    order = Window.partitionBy("kind", "k").orderBy("book_id")
    head = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("kind", "k", F.col("book_id").alias("cand"))
    own = keys.join(seeds.select(F.col("seed").alias("book_id")), "book_id", "left_semi").withColumnRenamed("book_id", "seed")
    both = own.join(head, ["kind", "k"]).where("seed <> cand").select("seed", "cand").distinct()
    first = Window.partitionBy("seed").orderBy("cand")
    return both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("seed", "cand")


def negative_samples(books: DataFrame, seeds: DataFrame, positives: DataFrame, k: int = 30) -> DataFrame:
    """(seed, cand): k rows per seed drawn by hash, without the seed and its positives.

    Three times as many as needed are drawn from a common shuffled order, at a place of the seed's own, and the first
    k of the rest stay; fewer if too many of them are excluded.
    """
    from .order import running

    shuffled = books.select(F.col("book_id").alias("cand")).withColumn("h", draw("neg", "cand"))
    order = scratch(running(shuffled, ["h", "cand"], F.lit(1).cast("long")).select("cand", F.col("before").alias("place")), "order")
    n = order.count()
    want = min(max(n - 1, 1), 3 * k)
    start = F.pmod(F.conv(F.substring(draw("start", "seed"), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    asked = seeds.select("seed", start.alias("s")).select("seed", F.explode(F.sequence(F.lit(0), F.lit(want - 1))).alias("i"), "s")
    asked = asked.select("seed", "i", F.pmod(F.col("s") + F.col("i"), F.lit(max(n, 1))).alias("place"))
    drawn = asked.join(order, "place").where("seed <> cand").join(positives, ["seed", "cand"], "left_anti")
    first = Window.partitionBy("seed").orderBy("i")
    return drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("seed", "cand")


def separation(features: DataFrame, positives: DataFrame, negatives: DataFrame, track: str, share: float = 0.95) -> dict:
    """{threshold, separation}: the given quantile of the negatives' scores, and the share of positives above it (0.5 if either is empty)."""
    score = lambda pairs: similarity.pair_scores(features, pairs, track).where("score IS NOT NULL")
    threshold = quantiles(score(negatives), F.round("score", 9), [share])[0]
    got = None if threshold is None else score(positives).agg(F.avg((F.round("score", 9) > threshold).cast("double"))).first()[0]
    return {"threshold": threshold, "separation": 0.5 if got is None else got}


def scorecard(stable: dict, separate: dict, unique: dict, baseline: dict | None = None, include_image: bool = True, image_cap: float = 0.1, other_cap: float = 0.6, by: tuple[float, float, float] = (0.4, 0.4, 0.1)) -> list[dict]:
    """Recommended weights: stability, separation and uniqueness (none for semantic) weighed, capped and normalised."""
    baseline = BASELINE if baseline is None else baseline
    raw = {}
    for t in sorted(baseline.keys() | stable.keys() | separate.keys() | unique.keys()):
        value = by[0] * stable.get(t, 0.0) + by[1] * separate.get(t, 0.0) + by[2] * (0.0 if t == "semantic" else unique.get(t, 0.0))
        raw[t] = min(image_cap if t == "image" else other_cap, max(0.0, value)) if include_image or t != "image" else 0.0
    total = sum(raw.values())
    return [
        {"track": t, "baseline": float(baseline.get(t, 0.0)), "recommended": v / total if total else 0.0, "stability": float(stable.get(t, 0.0)), "separation": float(separate.get(t, 0.0)), "uniqueness": 0.0 if t == "semantic" else float(unique.get(t, 0.0))}
        for t, v in raw.items()
    ]


def deltas(card: list[dict], least: float = 0.05) -> list[dict]:
    """Tracks whose recommended weight differs from the baseline by at least `least`, the largest gain first."""
    rows = [{**r, "delta": r["recommended"] - r["baseline"]} for r in card]
    return sorted((r for r in rows if abs(r["delta"]) >= least), key=lambda r: -r["delta"])


def diversity(picks: DataFrame, books: DataFrame) -> DataFrame:
    """(seed, hhi, year_range) of picks (seed, cand): concentration of the authors' texts, span of the years (0 if unknown)."""
    rows = picks.join(books.select(F.col("book_id").alias("cand"), "authors", F.col("original_publication_year").alias("y")), "cand")
    per = rows.groupBy("seed", "authors").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    total = F.sum("n")
    return per.groupBy("seed").agg((F.sum(F.col("n") * F.col("n")) / (total * total)).alias("hhi"), F.coalesce(F.max("hi") - F.min("lo"), F.lit(0.0)).alias("year_range"))


def diversity_messages(table: DataFrame, hhi_most: float = 0.5, years_least: float = 5) -> dict:
    """Medians of both measures, with what they say."""
    h, y = quantiles(table, F.col("hhi"), [0.5])[0], quantiles(table, F.col("year_range"), [0.5])[0]
    return {"hhi": h, "year_range": y, "authors": "dominated by few" if h is not None and h > hhi_most else "diverse", "years": "narrow" if y is not None and y < years_least else "wide"}


def author_dominance(near: DataFrame, books: DataFrame, limit: float = 0.60) -> DataFrame:
    """(seed, share, dominated): share of the neighbours that share an author with the seed."""
    names = F.col("author_list") if "author_list" in books.columns else T.author_list(F.col("authors"))
    side = lambda key, name: books.select(F.col("book_id").alias(key), names.alias(name))
    both = near.join(side("seed", "a"), "seed").join(side("cand", "b"), "cand")
    out = both.groupBy("seed").agg(F.avg(F.arrays_overlap("a", "b").cast("double")).alias("share"))
    return out.withColumn("dominated", F.col("share") > limit)


def length_of(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def vector_health(features: DataFrame, track: str) -> dict:
    """Rows, least, median and largest length of a track's vectors, and how many are nearly zero."""
    norms = features.where(F.col(column(track)).isNotNull()).select(length_of(F.col(column(track))).alias("n"))
    row = norms.agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum((F.col("n") < 1e-6).cast("long")).alias("near_zero")).first()
    return {"rows": row["rows"], "low": row["low"], "median": quantiles(norms, F.col("n"), [0.5])[0], "high": row["high"], "near_zero": row["near_zero"] or 0}


def norm_outlier_share(features: DataFrame, track: str, limit: float = 5.0) -> float | None:
    """Share of the rows whose length lies more than `limit` median deviations from the median."""
    norms = scratch(features.where(F.col(column(track)).isNotNull()).select(length_of(F.col(column(track))).alias("n")), "norms")
    mid = quantiles(norms, F.col("n"), [0.5])[0]
    if mid is None:
        return None
    far = F.abs(F.col("n") - F.lit(mid))
    mad = quantiles(norms, far, [0.5])[0]
    return norms.agg(F.avg((far / F.lit(mad + 1e-9) > limit).cast("double"))).first()[0]


def pick_seeds(books: DataFrame, features: DataFrame, n: int = 300, seed: int = 42) -> DataFrame:
    """(book_id, why): n random books, and the first one (by id) of each odd kind: no description, before 1900, modern,
    no cover, best rated (then with the longest description). An odd one isn't drawn again."""
    rows = books.select("book_id", F.length(F.coalesce("description", F.lit(""))).alias("size"), "average_rating", T.placeholder_url(F.col("image_url")).alias("no_cover"))
    rows = rows.join(features.select("book_id", "modern_flag", "pre_1900_flag"), "book_id")
    first = lambda cond: F.min(F.when(cond, F.col("book_id")))
    best = F.max_by("book_id", F.struct(F.coalesce("average_rating", F.lit(-1e9)), "size", -F.col("book_id")))
    odd = rows.agg(first(F.col("size") == 0).alias("no_description"), first(F.col("pre_1900_flag") == 1).alias("pre1900"), first(F.col("modern_flag") == 1).alias("modern"), first(F.col("no_cover")).alias("no_cover"), best.alias("top_rated"))
    odd = odd.unpivot([], odd.columns, "why", "book_id").where("book_id IS NOT NULL").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list("why")), "+").alias("why"))
    odd = scratch(odd, "odd")
    rest = books.select("book_id").join(odd, "book_id", "left_anti").orderBy(draw(seed, "book_id"), "book_id").limit(n)
    return odd.unionByName(rest.withColumn("why", F.lit("random")))


def interpretability_seeds(books: DataFrame, n: int = 5, seed: int = 123) -> DataFrame:
    """(book_id, why): n random books, and the shortest and longest description, fewest authors, no cover, oldest."""
    names = F.col("author_list") if "author_list" in books.columns else T.author_list(F.col("authors"))
    rows = books.select("book_id", T.word_count(F.col("description")).alias("w"), F.size(names).alias("a"), "original_publication_year", T.placeholder_url(F.col("image_url")).alias("no_cover"))
    low = lambda *by: F.min_by("book_id", F.struct(*by, "book_id"))
    year = F.col("original_publication_year")
    odd = rows.agg(
        low(F.col("w")).alias("shortest"), low(-F.col("w")).alias("longest"), low(F.col("a")).alias("fewest_authors"),
        F.min(F.when(F.col("no_cover"), F.col("book_id"))).alias("no_cover"), low(year.isNull(), year).alias("oldest"),
    )
    odd = odd.unpivot([], odd.columns, "why", "book_id").where("book_id IS NOT NULL").select("book_id", "why")
    drawn = books.select("book_id", F.lit("random").alias("why")).orderBy(draw(seed, "book_id"), "book_id").limit(n)
    return odd.unionByName(drawn)


def principal_components(features: DataFrame, track: str, k: int = 2) -> DataFrame:
    """(book_id, pc): projections on the first k principal axes of a dense track (signs fixed by the largest loading).

    The centred second moments are sums over the rows, so only a matrix of the vectors' width reaches the driver.
    """
    import numpy as np
    import pyarrow as pa

    from .similarity import dense_rows

    ship(features.sparkSession)
    rows = features.where(F.col(track).isNotNull()).select("book_id", F.col(track).cast("array<double>").alias("v"))

    def raw(col):
        (x, _), size = dense_rows(col), np.linalg.norm(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1), axis=1)
        return x * size[:, None]

    def moments(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.c_[np.ones(b.num_rows), raw(b.column("v"))]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = [np.array(r.m) for r in rows.mapInArrow(moments, "m array<double>").toLocalIterator()]  # one matrix per task
    if not parts:
        return rows.select("book_id", F.array().cast("array<double>").alias("pc"))
    width = int(round(len(parts[0]) ** 0.5))
    m = sum(parts).reshape(width, width)
    mean = m[0, 1:] / m[0, 0]
    _, axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def project(batches):
        for b in batches:
            if b.num_rows:
                y = (raw(b.column("v")) - mean) @ axes
                yield pa.RecordBatch.from_arrays([b.column("book_id"), pa.array(y.tolist(), pa.list_(pa.float64()))], ["book_id", "pc"])

    return rows.mapInArrow(project, "book_id long, pc array<double>")
