"""Text functions, cleaning, resolution, caps and re-ranking on small hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import blocks, evaluate, order, profile, rank, recommend, resolve, similarity
from strandwise.operators.similarity import TRACKS
from strandwise.plans import catalog
from strandwise.sources import books as B


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("f,x,y", [
    (T.collapse_ws, " a  b\t\nc ", "a b c"), (T.collapse_ws, None, ""), (T.typography, "‘a’ “b” – c\x07d", "'a' \"b\" - c d"),
    (T.title_key, "The Hobbit: (1937)!", "the hobbit 1937"), (T.canonical_author, "Clarke, Arthur C.", "Arthur C. Clarke"),
    (T.canonical_author, "Smith, A. and Jones", "Smith, A. and Jones"), (T.author_list, " A,,b , C", ["a", "b", "c"]),
    (T.trim_disclaimer, "Note: not the  actual book. Get a full copy of this great book. Real text", "Real text"),
    (T.trim_disclaimer, "not the actual book, no end", "not the actual book, no end"), (T.ascii_fold, "Été ﬁn", "Ete fin"),
])
def test_text(spark, f, x, y):
    assert one(spark, x, f) == y


def test_language_flag(spark):
    english = "the cat and the dog are in the house and they were not on the street when it was dark " * 3
    assert one(spark, english, T.suspected_non_english) is False
    assert one(spark, "Это просто короткий русский текст", T.suspected_non_english) is True
    assert one(spark, "le chat noir mange souris grise dans jardin vert petit grand maison " * 4, T.suspected_non_english) is True


BOOKS = "book_id long, title string, authors string, original_publication_year double, language_code string, average_rating double, image_url string, description string"


def test_consolidate_merges_transitively(spark):
    row = lambda i, t, a, y, r: (i, t, a, y, "en", r, None, f"text {i}")
    df = spark.createDataFrame([
        row(10, "Dune", "A, B", 1970.0, 4.0), row(11, "Dune!", "B, C", 1965.0, 5.0), row(12, "DUNE", "C, D", None, None), row(20, "Dune", "Z", 1990.0, 3.0), row(30, "Other", "A", None, 2.0), row(31, "Other", "a", None, 4.0),
    ], BOOKS)
    got = {r.book_id: r for r in resolve.consolidate(df).collect()}
    assert sorted(got) == [11, 20, 30]
    assert got[11].authors == "a, b, c, d" and got[11].average_rating == 4.5
    assert got[20].authors == "Z"
    clean = resolve.clean_books(df)
    again = resolve.clean_books(clean.withColumn("language_code", F.lit("en")).select(*[c.split()[0] for c in BOOKS.split(", ")]))
    assert sorted(clean.select("book_id", "title").collect()) == sorted(again.select("book_id", "title").collect())


def test_caps_interact(spark):
    rows = [(1, k + 1, c, a, d) for k, (c, a, d) in enumerate([(0, "x", "p"), (1, "x", "p"), (2, "x", "q"), (3, "y", "r"), (4, "x", "s"), (5, None, "t")])]
    df = spark.createDataFrame(rows, "seed long, rank int, cand long, author string, desc_hash string")
    got = rank.enforce_caps(df, 2, 1).orderBy("rank").collect()
    assert [r.cand for r in got] == [0, 2, 3, 5]


@pytest.mark.parametrize("mode", ["reference", "standard"])
def test_mmr_prune_is_exact(spark, mode):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = rng.random(80).round(6)
    picked, left, lam = [], list(range(80)), 0.95
    while len(picked) < 6:
        pen = lambda i: max((1 - v[i] @ v[j] if mode == "reference" else v[i] @ v[j]) for j in picked) if picked else 0.0
        pen = lambda i: max([0.0, *((1 - v[i] @ v[j] if mode == "reference" else v[i] @ v[j]) for j in picked)])
        best = max(left, key=lambda i: round(lam * rel[i] - (1 - lam) * pen(i), 12))
        picked.append(best)
        left.remove(best)
    r = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(rel)], "seed long, cand long, rel double")
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cand long, v array<double>")
    assert [x.cand for x in rank.mmr(r, e, 6, lam, mode).orderBy("rank").collect()] == picked


def test_weights():
    assert rank.renormalised({"a": 3, "b": -1}, ["a", "b"]) == {"a": 1.0, "b": 0.0}
    assert rank.renormalised({"a": 1}, ["b", "c"]) == {"b": 0.5, "c": 0.5}


def test_percentile_and_blend(spark):
    random.seed(1)
    s = spark.createDataFrame([(1, t, c, random.random() if c else None) for t in ("a", "b") for c in range(10)], "seed long, track string, cand long, score double")
    p = rank.rank_percentile(s).collect()
    assert sorted({round(r.pct, 6) for r in p}) == [0.0, *[round(k / 10, 6) for k in range(1, 10)]]
    assert {r.cand for r in p if r.pct == 0} == {0}


def wide(spark, n=40, seeds=(100, 200)):
    rng = random.Random(4)
    rows = [(s, c, 0b01111 if s == 100 else 0b00101, *[round(rng.random(), 2) if t != "image" and (s == 100 or t in ("tfidf", "authors")) else None for t in TRACKS]) for s in seeds for c in range(n)]
    return spark.createDataFrame(rows, "seed long, cand long, live int, " + ", ".join(f"{t} double" for t in TRACKS))


def test_ranks_are_the_same_in_one_task_and_in_ranges(spark):
    counts = {"n": 41, "tfidf": 41, "semantic": 41, "authors": 41, "numerics": 41, "image": 0}
    one, many = (sorted(map(tuple, rank.percentiles(wide(spark), counts, spread).select("seed", "cand", *[f"p_{t}" for t in TRACKS]).collect())) for spread in (False, True))
    assert one == many and len(one) == 80
    assert {r[3] for r in one if r[0] == 200} == {0.0}


def test_top_fused_is_the_blend(spark):
    counts = {"n": 41, "tfidf": 41, "semantic": 41, "authors": 41, "numerics": 41, "image": 0}
    ranked = rank.percentiles(wide(spark), counts)
    sets = [rank.DEFAULT_WEIGHTS, {"image": 1.0}, {"authors": 2.0, "tfidf": -1.0}]
    got = {(r.g, r.seed, r.cand): r.fused for r in rank.top_fused(ranked, sets, 7).collect()}
    rows = ranked.collect()
    for g, w in enumerate(sets, 1):
        for s in (100, 200):
            share = rank.renormalised(w, rank.live_tracks(0b01111 if s == 100 else 0b00101))
            want = sorted(((-round(sum(r[f"p_{t}"] * v for t, v in share.items()), 9), r.cand) for r in rows if r.seed == s))[:7]
            assert sorted((-round(v, 9), c) for (a, b, c), v in got.items() if (a, b) == (g, s)) == want
    direct = {(r.seed, r.cand): r.f for r in ranked.select("seed", "cand", rank.fused_column(rank.DEFAULT_WEIGHTS).alias("f")).collect()}
    assert all(abs(direct[b, c] - v) < 1e-12 for (a, b, c), v in got.items() if a == 1)


def test_running_and_quantiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = {(r.g, r.i): r.before for r in order.running(df, ["i"], F.col("v"), ["g"]).collect()}
    assert got == {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}
    xs = [rng.random() if rng.random() < 0.8 else None for _ in range(151)]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    have = np.array([x for x in xs if x is not None])
    assert order.quantiles(frame, F.col("x"), [0.0, 0.5, 0.95, 1.0]) == pytest.approx([have.min(), np.median(have), np.percentile(have, 95), have.max()])
    assert order.quantiles(frame.where("x > 2"), F.col("x"), [0.5]) == [None]
    sizes = order.with_group_count(df, ["g"]).collect()
    assert len(sizes) == 300 and all(r.n == sum(x[0] == r.g for x in rows) for r in sizes)


def test_mmr_over_sparse_spaces(spark):
    rel = spark.createDataFrame([(1, c, x) for c, x in enumerate([0.9, 0.89, 0.88, 0.87, 0.1])], "seed long, cand long, rel double")
    v = spark.createDataFrame([(0, [1, 2], [0.6, 0.8]), (1, [9], [1.0]), (2, [2, 1], [0.8, 0.6]), (3, [], []), (4, None, None)], "cand long, t_ids array<long>, t_w array<double>")
    assert [r.cand for r in rank.mmr(rel, v, 3, 0.5).orderBy("rank").collect()][:2] == [0, 2]
    assert [r.cand for r in rank.mmr(rel, v, 3, 0.5, "standard").orderBy("rank").collect()][:2] == [0, 1]


def test_csv(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('book_id,title,authors,original_publication_year,language_code,average_rating,image_url,description\n1,"A ""b""\nc",X,NA,en,4.5,,NaN\n')
    r = B.read_csv(spark, str(p)).first()
    assert (r.title, r.original_publication_year, r.image_url, r.description) == ('A "b"\nc', None, None, None)
    (tmp_path / "c.csv").write_text("book_id,title\n1,x\n")
    with pytest.raises(ValueError):
        B.read_csv(spark, str(tmp_path / "c.csv"))


def test_genre_cache(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"1": ["fantasy"], "3": []}')
    cache = B.read_genre_cache(spark, str(p))
    assert {r.book_id for r in cache.collect()} == {1, 3}
    assert B.read_genre_cache(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([(i, f"t{i}", "a", None, None, None, None, None) for i in range(5)], BOOKS)
    got = B.hydrate(df, cache, lambda t, a: ["x"] if t == "t2" else [], most=2).collect()
    assert {r.book_id for r in got} == {1, 2, 3} or {r.book_id for r in got} == {1, 3}


@pytest.mark.parametrize("n", [28, 98, 200, 232])
def test_spearman_of_a_constant_is_null(spark, n):
    """Merged partial variances of a constant are a little above 0 for these numbers of rows."""
    df = spark.range(0, n, 1, 2).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b"), (-F.col("id")).cast("double").alias("c"))
    got = {(r.a, r.b): r.rho for r in profile.spearman(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None
    assert got["a", "c"] == pytest.approx(-1)


@pytest.mark.parametrize("mode, lam, space", [("standard", 0.9, "numerics|authors"), ("reference", 0.95, "semantic")])
def test_vectors_move_only_to_rows_that_can_win(spark, mode, lam, space):
    """Re-ranking in blocks picks what rank.mmr does over all rows, from a small part of the rows."""
    t = catalog.tracks(spark, "/root/testdata/sf0.01")
    s = catalog.seeds(spark, "/root/testdata/sf0.01")
    weights = rank.DEFAULT_WEIGHTS
    got = recommend.best(t, s, [weights], 4, mmr=mode, lam=lam, space=space, digits=9).select("seed", "rk", "cand")
    pairs = recommend.fused(recommend.ranked_pairs(t, s), t, recommend.Options(weights=weights)).select("seed", "cand", F.round("fused", 9).alias("rel"))
    pairs = pairs.cache()
    spaces = recommend.usable_spaces(space, t.counts())
    want = rank.mmr(pairs, t.features.select(F.col("book_id").alias("cand"), *similarity.columns(spaces)), 4, lam, mode).select("seed", "rank", "cand")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ask = blocks.Ask((), 4, mmr=mode, lam=lam, spaces=spaces, digits=9)
    f = np.array([r.rel for r in pairs.where("seed = 100").collect()])
    assert 4 <= len(blocks._can_win(f, ask)) < len(f) / 2
    assert [c.split()[0] for c in blocks._MOVED.split(", ")] == ["grp", "ids", "era", "scores"]  # no vectors


@pytest.mark.parametrize(
    "weights, k, bias, whole",
    [([rank.DEFAULT_WEIGHTS], 5, 0.0, False), ([rank.DEFAULT_WEIGHTS], 5, 0.02, False), (evaluate.weight_grid(), 10, 0.0, False), ([{"image": 1.0}], 400, 0.0, True)],
)
def test_best_rows_without_moving_scores(spark, monkeypatch, weights, k, bias, whole):
    """The rows equal those ranked from all scores, which move only if the k best reach into rows without a vector."""
    t = catalog.tracks(spark, "/root/testdata/sf0.01")
    s = catalog.seeds(spark, "/root/testdata/sf0.01")
    best = lambda: sorted(recommend.best(t, s, weights, k, year_bias=bias).drop("fused").collect(), key=lambda r: (r.g, r.seed, r.rk))
    want, ranked, moved = best(), [], blocks._ranked
    monkeypatch.setattr(blocks, "SAMPLE", 100)
    monkeypatch.setattr(blocks, "_ranked", lambda rows, sent, seeds, *a: ranked.extend(seeds) or moved(rows, sent, seeds, *a))
    assert best() == want
    assert bool(ranked) == whole


def moved_seeds(monkeypatch, sample):
    """Seeds whose scores move from now on, with so small a sample."""
    ranked, moved = [], blocks._ranked
    monkeypatch.setattr(blocks, "SAMPLE", sample)
    monkeypatch.setattr(blocks, "_ranked", lambda rows, sent, seeds, *a: ranked.extend(seeds) or moved(rows, sent, seeds, *a))
    return ranked


def in_order(df):
    return sorted(df.drop("fused").collect(), key=lambda r: (r.g, r.seed, r.rk))


def test_settings_of_one_track_without_moving_scores(spark, monkeypatch):
    """Rows above the sample's last mark are guessed alike, which must not leave the order of a single track open."""
    t, s = catalog.tracks(spark, "/root/testdata/sf0.01"), catalog.seeds(spark, "/root/testdata/sf0.01")
    settings = [{x: 1.0} for x in ("tfidf", "authors", "numerics")]
    want = in_order(recommend.best(t, s, settings, 2))
    ranked = moved_seeds(monkeypatch, 20)
    assert in_order(recommend.best(t, s, settings, 2)) == want
    assert not ranked


def test_weights_by_candidate_without_moving_scores(spark, monkeypatch):
    t, s = catalog.tracks(spark, "/root/testdata/sf0.01"), catalog.seeds(spark, "/root/testdata/sf0.01")
    want = in_order(recommend.best(t, s, [rank.DEFAULT_WEIGHTS], 5, per_candidate=True))
    ranked = moved_seeds(monkeypatch, 100)
    assert in_order(recommend.best(t, s, [rank.DEFAULT_WEIGHTS], 5, per_candidate=True)) == want
    assert len(ranked) < 5


@pytest.mark.parametrize("mode, lam, space, digits, few", [("reference", 0.95, "semantic", None, 0), ("standard", 0.9, "numerics|authors", 9, 0), ("reference", 0.95, "semantic", 9, 1)])
def test_reranking_without_moving_scores(spark, monkeypatch, mode, lam, space, digits, few):
    """Plain and re-ranked picks of one pass are those of two runs over all scores; few: rows ranked for each one asked for."""
    t, s = catalog.tracks(spark, "/root/testdata/sf0.01"), catalog.seeds(spark, "/root/testdata/sf0.01")
    weights = [rank.DEFAULT_WEIGHTS]
    off, on = recommend.best(t, s, weights, 4), recommend.best(t, s, weights, 4, mmr=mode, lam=lam, space=space, digits=digits)
    want = in_order(off.unionByName(on.withColumn("g", F.col("g") + 1)))
    ranked = moved_seeds(monkeypatch, 100)
    monkeypatch.setattr(blocks, "SPARE_MMR", few or 64)
    assert in_order(recommend.best(t, s, weights, 4, mmr=mode, lam=lam, space=space, digits=digits, plain=True)) == want
    assert ranked if few else len(ranked) < 5
