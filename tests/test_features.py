"""Tracks, artifact store, recommendations and jobs on small hand-made catalogues."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise import jobs
from strandwise.features import bundle, embed, lexical, metadata
from strandwise.features.store import ArtifactStore, content_hash, fingerprint
from strandwise.operators import diagnose, evaluate, profile, recommend, similarity
from strandwise.sources import books as B

BOOKS = "book_id long, title string, authors string, original_publication_year double, language_code string, average_rating double, image_url string, description string"
ROWS = [
    (1, "A Wizard", "Ursula, Bob", 1968.0, "en", 4.0, "http://x/1", "magic school of wizards and dragons in the sea"),
    (2, "Dark Matter", "Blake", 2016.0, "en", 4.1, "http://x/2", "physics of many worlds and a lost family"),
    (3, "Dragons", "Ursula", 1999.0, "en", None, None, "dragons and magic and wizards again in the sea"),
    (4, "Old Tale", "Leo", 1875.0, "en", 3.5, "http://x/nophoto.png", None),
    (5, "Worlds", "Blake, Ann", 2008.0, "en", 3.9, "", "many worlds and physics with a family"),
    (6, "Café Été", "", 2010.0, "en", 4.4, "http://x/6", ""),
]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(ROWS, BOOKS)


SMALL = lexical.Params(min_df=1, max_df=1.0)


def _fetch():
    def fetch(url):  # nested, so that it is sent to the workers by value
        if url.endswith("6"):
            raise OSError("gone")
        return b"P6 4 2 255\n" + bytes(range(24))

    return fetch


fetch = _fetch()


@pytest.fixture(scope="module")
def tracks(spark, books, tmp_path_factory):
    return bundle.fit_or_load_all(books, str(tmp_path_factory.mktemp("store")), params=SMALL, fetch=fetch, image_encoder=embed.PixelEncoder)


def test_transform_equals_fit(spark, books):
    words = lexical.corpus(books, SMALL)
    counts = lexical.term_counts(words, SMALL)
    vocabulary = lexical.fit(counts, 6, SMALL)
    key = lambda df: sorted((r.book_id, tuple(sorted(zip(r.ids, np.round(r.w, 12), strict=True)))) for r in df.collect())
    assert key(lexical.vectors(words, counts, vocabulary, SMALL)) == key(lexical.transform(books, vocabulary, SMALL))
    assert lexical.fit(counts, 6, lexical.Params()).count() == 0
    assert lexical.vectors(words, counts, lexical.fit(counts, 6, lexical.Params())).where("size(ids) > 0").count() == 0
    new = spark.createDataFrame([(9, "zzz", "", None, None, None, None, "unseen")], BOOKS)
    assert lexical.transform(new, vocabulary, SMALL).first().ids == []
    assert {r.words[0] for r in words.where("book_id = 6").collect()} == {"cafe"}


def test_numerics(spark):
    rows = [(1, "a b c", ["x"], 4.0, 1875.0), (2, "a", ["x", "y"], 5.0, 1900.0), (3, None, [], None, 2000.0), (4, "a b", [" "], 3.0, 2050.0), (5, "", ["z"], 4.0, None)]
    df = spark.createDataFrame(rows, "book_id long, description string, author_list array<string>, average_rating double, original_publication_year double")
    raw = metadata.raw_numerics(df)
    got = {r.book_id: r for r in metadata.transform_numerics(raw, metadata.fit_numerics(raw)).collect()}
    assert [got[k].modern_flag for k in range(1, 6)] == [0, 0, 1, 1, 0] and [got[k].pre_1900_flag for k in range(1, 6)] == [1, 0, 0, 0, 0]
    assert [got[k].author_count_int for k in range(1, 6)] == [1, 2, 0, 0, 1]
    assert got[3].average_rating_minmax == 0 and got[2].average_rating_minmax == 1 and got[4].year_norm == 1 and got[5].year_norm == 0


def test_letterbox_and_covers(spark, books, tracks):
    x = embed.letterbox(np.full((20, 40, 3), 255, np.uint8), 8)
    assert x.shape == (3, 8, 8) and np.allclose(x[:, 4, 4], [(1 - m) / s for m, s in zip(embed.MEAN, embed.STD, strict=True)], atol=1e-5)
    assert np.allclose(x[:, 0, 0], [-m / s for m, s in zip(embed.MEAN, embed.STD, strict=True)], atol=1e-5)
    assert np.allclose(embed.resize_weights(4, 4), np.eye(4)) and np.allclose(embed.resize_weights(8, 4).sum(axis=1), 1)
    assert embed.read_ppm(b"JPEG") is None and embed.read_ppm(b"P6 2 1 255\n123456").shape == (1, 2, 3)
    found = {r.book_id: r for r in embed.covers(books, fetch).collect()}
    assert [k for k, r in sorted(found.items()) if r.data is not None] == [1, 2] and [k for k, r in found.items() if r.placeholder] == [4]
    assert tracks.features.where("image IS NOT NULL").count() == 2


def test_cover_cache_is_used(spark, books, tmp_path):
    import hashlib

    (tmp_path / (hashlib.md5(b"http://x/6").hexdigest() + ".jpg")).write_bytes(b"cached")
    got = {r.book_id: r.data for r in embed.covers(books, lambda url: None, embed.cover_folder(spark, str(tmp_path))).collect()}
    assert bytes(got[6]) == b"cached" and got[1] is None


def test_store_hits_and_misses(spark, books, tmp_path):
    store, made = ArtifactStore(spark, str(tmp_path)), []
    build = lambda: (made.append(1), spark.range(3).toDF("x"))[1]
    assert store.cached("t", "h1", {"a": 1}, build).count() == 3
    assert store.cached("t", "h1", {"a": 1}, build).count() == 3 and len(made) == 1
    store.cached("t", "h1", {"a": 2}, build)
    store.cached("t", "h2", {"a": 2}, build)
    store.cached("t", "h2", {"a": 2}, build, force=True)
    assert len(made) == 4
    with open(tmp_path / "t" / "manifest.json", "w") as f:
        f.write("{broken")
    (tmp_path / "t" / ".manifest.json.crc").unlink(missing_ok=True)
    assert store.cached("t", "h2", {"a": 2}, build).count() == 3 and len(made) == 5
    a, b = content_hash(books, "book_id", "title"), content_hash(books.repartition(3), "book_id", "title")
    assert a == b != content_hash(books.withColumn("title", F.upper("title")), "book_id", "title") and content_hash(books.limit(0), "book_id") == ""
    assert fingerprint(books) == fingerprint(books.repartition(3)) != fingerprint(books.where("book_id < 6"))


def test_failing_track_is_left_out(spark, books, tmp_path):
    class Broken:
        def encode(self, items):
            raise RuntimeError("no model")

    t = bundle.fit_or_load_all(books, str(tmp_path), params=SMALL, text_encoder=Broken, enable={"authors": False})
    n = t.counts()
    assert n["semantic"] == 0 and n["authors"] == 0 and n["tfidf"] == 6
    assert recommend.recommend(t, spark.createDataFrame([(1,)], "seed long")).count() == 4  # two books without a description share one cap


def test_recommend_by_id(tracks):
    got = recommend.recommend_by_id(tracks, 1, recommend.Options(k=3, mmr=False))
    assert got["picked"][0]["book_id"] == 3 and set(got["modality_percentiles"]) == {"tfidf", "semantic", "authors", "numerics", "image"}
    with pytest.raises(KeyError):
        recommend.recommend_by_id(tracks, 77)
    assert [r["book_id"] for r in recommend.recommend_by_id(tracks, 2, recommend.Options(k=9, mmr_space="tfidf|authors"))["picked"]][0] == 5


def test_caps_may_leave_less_or_be_filled_up(spark, tracks):
    one = spark.createDataFrame([(1,)], "seed long")
    plain = recommend.recommend(tracks, one, recommend.Options(k=3, mmr=False, caps=(9, 1)))
    full = recommend.recommend(tracks, one, recommend.Options(k=3, mmr=False, caps=(9, 1), backfill=True))
    assert plain.count() <= 3 and full.count() == 3


def test_seed_blocks(spark, tracks, monkeypatch):
    seeds = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 6, 99)], "seed long")
    key = lambda df: sorted((r.seed, r.cand, r.live, *[None if r[t] is None else round(r[t], 9) for t in similarity.TRACKS]) for r in df.collect())
    whole = key(similarity.score_pairs(tracks.features, seeds))
    monkeypatch.setattr(similarity, "SEEDS", 2)
    monkeypatch.setattr(similarity, "CELLS", 3)
    assert key(similarity.score_pairs(tracks.features, seeds)) == whole and len(whole) == 30
    assert similarity.score_pairs(tracks.features, seeds.where("seed > 50")).count() == 0
    assert similarity.nearest(tracks.features, seeds, "tfidf", 2).where("seed = 1 AND rk = 1").first().cand == 3


def test_scorecard_and_deltas():
    card = {r["track"]: r for r in diagnose.scorecard({"semantic": 1.0, "tfidf": 0.5}, {"semantic": 1.0}, {"semantic": 9.0, "tfidf": 1.0, "image": 9.0})}
    raw = {"semantic": 0.6, "tfidf": 0.3, "image": 0.1, "authors": 0.0, "numerics": 0.0}
    assert all(card[t]["recommended"] == pytest.approx(v / 1.0) for t, v in raw.items()) and card["semantic"]["uniqueness"] == 0
    off = {r["track"]: r["recommended"] for r in diagnose.scorecard({}, {}, {"image": 9.0}, include_image=False)}
    assert set(off.values()) == {0.0}
    assert [r["track"] for r in diagnose.deltas(list(card.values()))] == ["semantic", "tfidf", "authors", "numerics"]


def test_rank_lists(spark):
    lists = spark.createDataFrame([(t, s, c, k + 1) for t, s, cs in (("semantic", 1, [3, 4, 5]), ("tfidf", 1, [4, 3, 9]), ("semantic", 2, [1, 7, 8]), ("tfidf", 2, [4, 5, 6])) for k, c in enumerate(cs)], "track string, seed long, cand long, rk int")
    assert {r.seed: round(r.jaccard, 6) for r in diagnose.jaccard_at_k(lists, 3).collect()} == {1: 0.666667, 2: 0.0}
    assert {r.seed: r.tau for r in diagnose.kendall_tau(lists, 3).collect()} == {1: -1.0, 2: 0.0}


def test_genres(spark):
    cache = spark.createDataFrame([(1, ["Epic Fantasy", " "]), (2, ["Nonfiction"]), (3, []), (4, ["universe", "xyz"]), (5, None)], "book_id long, genres array<string>")
    got = {r.book_id: r.combo for r in evaluate.coarse_genres(cache).collect()}
    assert got == {1: ["fantasy"], 2: ["fiction"], 3: ["other"], 4: ["other", "poetry"], 5: ["other"]}
    igf = {r.key: round(r.igf, 6) for r in evaluate.igf_weights(evaluate.coarse_genres(cache)).collect()}
    assert igf == {"fantasy": 1.0, "fiction": 1.0, "other|poetry": 1.0, "other": round((6 / 3) / (6 / 2), 6)}
    assert evaluate.igf_weights(evaluate.coarse_genres(cache.limit(0))).count() == 0
    picks = spark.createDataFrame([(1, 2), (3, 5), (3, 4), (3, 77)], "seed long, cand long")
    hits = {(r.seed, r.cand): r.genre for r in evaluate.genre_hits(picks, evaluate.coarse_genres(cache), None).collect()}
    assert hits == {(1, 2): 0.0, (3, 5): 1.0, (3, 4): 1.0, (3, 77): 1.0}
    assert len(evaluate.weight_grid()) == 16 and len(evaluate.fine_sweep({"tfidf": 0.3, "semantic": 0.4, "authors": 0.2, "numerics": 0.1})) <= 243


def test_short_tables_have_no_shape(spark):
    df = spark.createDataFrame([(float(x),) for x in range(9)], "x double")
    assert profile.shape(df, F.col("x")) == {"n": 9, "skew": None, "kurt": None}
    assert profile.gini(df.limit(0), F.col("x")) is None and profile.gini(df.where("x = 0"), F.col("x")) == 0.0


def test_sources(spark, books, tmp_path):
    B.write_genre_cache(spark.createDataFrame([(1, ["a"])], "book_id long, genres array<string>"), str(tmp_path / "g"))
    assert B.load_genre_cache(spark, str(tmp_path / "g")).first().genres == ["a"] and B.load_genre_cache(spark, str(tmp_path / "none")).count() == 0
    cache = B.ensure_genre_cache(books, str(tmp_path / "h"), lambda t, a: ["x"] if "Dragons" in t else [], 5)
    assert [r.book_id for r in cache.collect()] == [3] and B.coverage(books, cache) == pytest.approx(1 / 6)
    assert B.subject_search(lambda p: {"docs": [{"subject_facet": [" a ", "", 3]}]}, "t", "u") == ["a"] and B.subject_search(lambda p: None, "t", None) == []
    items = lambda *infos: lambda p: {"items": [{"volumeInfo": i} for i in infos]}
    assert B.volume_categories(items({"title": 1}, {"categories": ["c"]}), "t", "u") == ["c"] and B.volume_categories(items({}, {"categories": ["c"]}), "t", "u") == []
    B.write_json(spark, str(tmp_path / "x.json"), {"a": np.float32(0.5), "b": np.arange(2), "c": {3, 1}, 4: None})
    assert json.load(open(tmp_path / "x.json")) == {"a": 0.5, "b": [0, 1], "c": [1, 3], "4": None}
    with pytest.raises(FileNotFoundError):
        B.read_csv(spark, str(tmp_path / "missing.csv"))


def test_jobs(spark, books, tmp_path):
    out = jobs.eda_reports(books, str(tmp_path / "eda"))
    assert len(out) == 4 and json.load(open(tmp_path / "eda" / "profile.json"))["rows"] == 6 and open(tmp_path / "eda" / "vocab_size.txt").read().isdigit()
    got = jobs.hybrid(books, str(tmp_path / "run"), lambda t, a: ["magic"], params=SMALL)
    assert got["seed_book_id"] == 1 and got["picked"][0]["rank"] == 1 and abs(sum(got["weights"].values()) - 1) < 0.6
    assert os.path.exists(tmp_path / "run" / "top5_1.json") and os.path.exists(tmp_path / "run" / "weights_selected.json")


def test_vocabulary_in_slices(spark, monkeypatch):
    """Each slice moves only its own terms, and together they give the vocabulary of one pass."""
    words = spark.createDataFrame([(i, [f"w{(i * k) % 23}" for k in range(12)] + ["x", "y"] * (i % 3)) for i in range(60)], "book_id long, words array<string>")
    p = lexical.Params(min_df=2, max_features=200)
    want = lexical.fit(lexical.term_counts(words, p), 60, p)
    batch = words.toArrow().to_batches()
    terms = [{t for b in lexical._stats(batch, True, k, 4) for t in b.column("term").to_pylist()} for k in range(4)]
    whole = {t for b in lexical._stats(batch, True) for t in b.column("term").to_pylist()}
    assert sum(map(len, terms)) == len(whole) and set.union(*terms) == whole and all(len(t) < len(whole) / 2 for t in terms)
    monkeypatch.setattr(lexical, "SLICE", 15)
    assert sorted(lexical.fit_words(words, 60, p).collect()) == sorted(want.collect())


def test_features_in_slices(spark, books, tracks, tmp_path, monkeypatch):
    """Written slice by slice, each moving only its own word lists, the features are those of one pass."""
    monkeypatch.setattr(lexical, "SLICE", 2)
    monkeypatch.setattr(lexical, "LISTS", 1)
    words = lexical.kept_corpus(books, SMALL)
    assert lexical.slices(6) == 3 and lexical.slices(10**9) == lexical.SLICES and words.select("slice").distinct().count() > 1
    parts = bundle.assemble(books, words, True, True, None, None, SMALL).parts
    ids = [{r.book_id for r in p.select("book_id").collect()} for p in parts]
    assert len(parts) == 3 and sum(map(len, ids)) == 6 and set.union(*ids) == {1, 2, 3, 4, 5, 6}
    t = bundle.fit_or_load_all(books, str(tmp_path), params=SMALL, fetch=fetch, image_encoder=embed.PixelEncoder)
    assert t.features.columns == tracks.features.columns
    key = lambda df: sorted((r.book_id, sorted(zip(r.tfidf_ids, np.round(r.tfidf_w, 12), strict=True)), r.authors_ids, r.numerics, r.semantic, r.image, r.year) for r in df.collect())
    assert key(t.features) == key(tracks.features)
