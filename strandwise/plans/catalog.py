"""Registered queries of the catalogue engine, each an operator applied to tables of the driver's data.

The SQL they are checked with is written by hand in oracle.py and shares no text with these plans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features import bundle, embed, lexical, metadata
from ..features.store import ArtifactStore, content_hash, fingerprint
from ..functions import text as T
from ..jobs import author_flips as flips
from ..operators import diagnose, evaluate, order, profile, rank, recommend, resolve, similarity
from ..runtime import scratch, scratch_until, shared_root
from ..sources import books as B

#: Genre names given to the clusters of the demonstration table.
DEMO_GENRES = ["Epic Fantasy", "Space Opera, Dystopia", "Historical Romance", "War memoir", "Poems", "Cooking", "Young adult", "Crime", "Essays", "Manga"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# The demonstration catalogue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


books = B.demo_books


def vectors(spark, sf_dir) -> DataFrame:
    """(book_id, v) of the books that have an embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("book_id"), F.col("embedding").alias("v"))
    return e.join(books(spark, sf_dir).select("book_id"), "book_id", "left_semi")


def cover_vectors(spark, sf_dir) -> DataFrame:
    """(book_id, v) of the books with a cover: the first 16 numbers of their embedding stand for one."""
    have = books(spark, sf_dir).where(~T.placeholder_url(F.col("image_url"))).select("book_id")
    return vectors(spark, sf_dir).join(have, "book_id").select("book_id", F.slice("v", 1, 16).alias("v"))


def tracks(spark, sf_dir) -> bundle.Tracks:
    """The fitted tracks: fitted by the first query of a session that needs them, then taken from the artifact store."""
    b = books(spark, sf_dir)
    store = ArtifactStore(spark, f"{shared_root(spark)}/strandwise-demo-{spark.sparkContext.applicationId}")
    content = "/".join(map(fingerprint, (b, vectors(spark, sf_dir), cover_vectors(spark, sf_dir))))

    def build() -> list[DataFrame]:
        words = lexical.kept_corpus(b)
        return bundle.assemble(b, words, True, True, vectors(spark, sf_dir), cover_vectors(spark, sf_dir), lexical.Params()).parts

    with scratch_until(spark):  # the fit's word lists and counts are not needed beside the features
        features = store.cached(f"features-{hashlib.sha256(content.encode()).hexdigest()[:16]}", content, {}, build)
    return bundle.Tracks(features, b)


def seeds(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).where("book_id % 100 = 0").select(F.col("book_id").alias("seed"))


def ranked(spark, sf_dir) -> tuple[bundle.Tracks, DataFrame]:
    t = tracks(spark, sf_dir)
    return t, recommend.ranked_pairs(t, seeds(spark, sf_dir))


def picks(spark, sf_dir, k: int, bias: float = 0.0) -> tuple[bundle.Tracks, DataFrame, DataFrame]:
    """The tracks, the k best by the default weights with their percentiles, and as (seed, cand, fused, rk)."""
    t = tracks(spark, sf_dir)
    r = recommend.best(t, seeds(spark, sf_dir), [rank.DEFAULT_WEIGHTS], k, year_bias=bias)
    return t, r, r.select("seed", "cand", "fused", "rk")


def genre_cache(spark, sf_dir) -> DataFrame:
    """(book_id, genres) of the books with an embedding, named after its cluster."""
    names = F.element_at(F.array(*map(F.lit, DEMO_GENRES)), (F.col("label") % len(DEMO_GENRES) + 1).cast("int"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("book_id"), F.split(names, ",").alias("genres"))
    return e.join(books(spark, sf_dir).select("book_id"), "book_id", "left_semi")


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    return df.select(*[F.round(c, more.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def one_row(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# Sources and look-ups


@query
def cache_anti_join(spark, sf_dir):
    return B.cache_misses(books(spark, sf_dir), vectors(spark, sf_dir)).select("book_id")


@query
def cache_coverage(spark, sf_dir):
    return one_row(spark, coverage=round(B.coverage(books(spark, sf_dir), genre_cache(spark, sf_dir)), 6))


@query
def id_lookup(spark, sf_dir):
    return books(spark, sf_dir).where("book_id IN (0, 100, 199, -5)").select("book_id", "title", "authors")


@query
def exact_title_lookup(spark, sf_dir):
    """For each seed the smallest book with the seed's title, case and outer white space apart."""
    b = books(spark, sf_dir).select("book_id", F.lower(F.trim("title")).alias("q"))
    first = b.groupBy("q").agg(F.min("book_id").alias("found"))
    return b.where("book_id % 100 = 0").join(first, "q").select("book_id", "found")


@query
def author_flips(spark, sf_dir):
    return flips(books(spark, sf_dir)).select("book_id", "authors")


@query
def image_mask(spark, sf_dir):
    skip = T.placeholder_url(F.col("image_url"))
    return books(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(skip.cast("long")).alias("placeholders"))


@query
def cover_html(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", T.cover_html(F.col("image_url"), 90).alias("html"))


@query
def payload_sha1(spark, sf_dir):
    return B.payload_hash(books(spark, sf_dir), "description")


@query
def content_digest(spark, sf_dir):
    """The ordered SHA-256 of the catalogue, as the artifact store uses it."""
    return one_row(spark, digest=content_hash(books(spark, sf_dir), "book_id", "title", "description"))


# Text functions and cleaning


@query
def text_normalise(spark, sf_dir):
    c = F.col
    return books(spark, sf_dir).select(
        "book_id", F.md5(T.collapse_ws(c("title"))).alias("title_h"), F.md5(T.collapse_ws(c("description"))).alias("desc_h"), T.placeholder_url(c("image_url")).alias("placeholder"))


@query
def typography(spark, sf_dir):
    text = F.concat(F.lit("‘a’ “b”–c—d\t"), F.col("description"))
    return books(spark, sf_dir).select("book_id", F.md5(T.typography(text)).alias("h"))


@query
def disclaimer_trim(spark, sf_dir):
    """Descriptions with a disclaimer put before every third one, and half a one before others."""
    k = F.col("book_id") % 3
    head = F.when(k == 0, "This is NOT the actual   book. Buy the full copy of this great book. ").when(k == 1, "not the actual book: ").otherwise("")
    return books(spark, sf_dir).select("book_id", F.md5(T.trim_disclaimer(F.concat(head, "description"))).alias("h"))


@query
def title_keys(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", T.title_key(F.col("title")).alias("title_key"), F.size(T.author_list(F.col("authors"))).alias("n_authors"))


@query
def lang_flag(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", T.suspected_non_english(F.col("description")).alias("flag"))


@query
def future_year_decade(spark, sf_dir):
    y = F.col("original_publication_year")
    return books(spark, sf_dir).select("book_id", T.known_year(y).alias("year"), T.decade(y).alias("decade"))


@query
def description_length(spark, sf_dir):
    return profile.description_length(books(spark, sf_dir))


@query
def ascii_folded_titles(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", T.tfidf_title(F.col("title")).alias("title"))


@query
def authors_canonical(spark, sf_dir):
    """Authors "Last, First" (made from the source's name) before and after canonicalisation."""
    rows = books(spark, sf_dir).select("book_id", F.array(F.concat(F.lit("Last "), F.element_at(F.split("authors", ","), 1), F.lit(",  First")), F.lit("A and B, C")).alias("author_list"))
    return rows.select("book_id", F.array_join(metadata.author_column(rows), "|").alias("after"))


@query
def authors_changed(spark, sf_dir):
    """Share of the rows that canonicalisation changes: all of those whose names are turned around, none of the others."""
    name = F.element_at(F.split("authors", ","), 1)
    rows = books(spark, sf_dir).select("book_id", F.array(F.when(F.col("book_id") % 4 == 0, F.concat(name, F.lit(", X"))).otherwise(name)).alias("author_list"))
    share, examples = metadata.changed_authors(rows)
    return examples.select("book_id", F.array_join("after", "|").alias("after"), F.lit(round(share, 6)).alias("share"))


@query
def entity_resolution(spark, sf_dir):
    out = resolve.consolidate(books(spark, sf_dir))
    return out.select("book_id", "authors", F.round("average_rating", 6).alias("average_rating"), "merged_rows")


@query
def clean_books(spark, sf_dir):
    out = resolve.clean_books(books(spark, sf_dir))
    return out.select(
        "book_id", F.md5("title").alias("title_h"), "authors", F.size("author_list").alias("n_authors"), "original_publication_year", F.round("average_rating", 6).alias("average_rating"),
        F.md5("description").alias("description_h"), "desc_suspected_non_english", "desc_hash", "desc_group_size", "desc_is_shared")


@query
def run_manifest(spark, sf_dir):
    return rounded(profile.run_manifest(resolve.clean_books(books(spark, sf_dir))))


# Profiles and reports


@query
def null_report(spark, sf_dir):
    return profile.null_report(books(spark, sf_dir))


NUMERIC = [("books", "original_publication_year"), ("books", "average_rating"), ("orders", "o_totalprice"), ("customer", "c_acctbal")]


@query
def profile_numeric(spark, sf_dir):
    out = profile.numeric_profile(books(spark, sf_dir), [c for t, c in NUMERIC if t == "books"])
    for t, c in NUMERIC[2:]:
        out = out.unionByName(profile.numeric_profile(table(spark, sf_dir, t), [c]))
    return rounded(out, 5)


@query
def profile_categorical(spark, sf_dir):
    return profile.categorical_profile(books(spark, sf_dir), profile.CATEGORICAL)


@query
def value_counts_topk(spark, sf_dir):
    return profile.top_values(books(spark, sf_dir), "language_code", 10).withColumnRenamed("value", "language_code")


@query
def unusual_chars(spark, sf_dir):
    return profile.unusual_chars(books(spark, sf_dir), "description")


@query
def vocab_size(spark, sf_dir):
    return one_row(spark, vocabulary=profile.vocabulary_size(books(spark, sf_dir)))


@query
def skew_kurt(spark, sf_dir):
    s = profile.shape(table(spark, sf_dir, "orders"), F.col("o_totalprice"))
    return one_row(spark, n=s["n"], skew=round(s["skew"], 6), kurt=round(s["kurt"], 6))


@query
def gini(spark, sf_dir):
    """Of quantities, and of account balances, some of which are negative."""
    a, b = profile.gini(table(spark, sf_dir, "lineitem"), F.col("l_quantity")), profile.gini(table(spark, sf_dir, "customer"), F.col("c_acctbal"))
    return one_row(spark, quantity=round(a, 6), balance=round(b, 6))


@query
def lognormalish(spark, sf_dir):
    out = profile.lognormalish(books(spark, sf_dir), F.length("description"))
    return one_row(spark, skew=round(out["skew"], 6), gini=round(out["gini"], 6), lognormalish=out["lognormalish"])


@query
def feature_ratios(spark, sf_dir):
    b = books(spark, sf_dir)
    nan = b.agg(profile.nan_ratio("original_publication_year")).first()[0]
    mid = order.quantiles(b, F.length("description"), [0.5])[0]
    above = b.agg(F.sum(profile.median_split(b, F.length("description")))).first()[0]
    return one_row(
        spark, year_nan=round(nan, 6), author_unique=round(profile.unique_ratio(b, "authors"), 6), language_top_share=round(profile.top_share(b, "language_code"), 6),
        median_length=mid, above_median=above)


@query
def feature_actions(spark, sf_dir):
    b = books(spark, sf_dir)
    counts = {"exact": profile.exact_dups(b).count(), "overlap": profile.title_author_dups(b).count()}
    rows = [(r["feature"], r["action"]) for r in profile.feature_actions(b, counts)]
    return spark.createDataFrame(rows, "feature string, action string")


@query
def histogram_rating(spark, sf_dir):
    return profile.histogram(books(spark, sf_dir), F.col("average_rating"), 1.0, 0.25)


@query
def dup_exact(spark, sf_dir):
    return profile.exact_dups(books(spark, sf_dir)).select("book_id", "n")


@query
def dup_same_desc(spark, sf_dir):
    out = profile.same_description(books(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return out.select("h", "n_rows", "sample", F.size("titles").alias("titles"), joined("authors"), joined("years"), joined("book_ids"))


@query
def desc_hash_groups(spark, sf_dir):
    out = profile.same_description(books(spark, sf_dir), by_hash=True)
    return out.select(F.col("h").alias("desc_hash"), "n_rows", F.array_join(F.col("book_ids").cast("array<string>"), "|").alias("book_ids"))


@query
def dup_title_author_pairs(spark, sf_dir):
    return profile.title_author_dups(books(spark, sf_dir))


@query
def desc_groups(spark, sf_dir):
    b = books(spark, sf_dir).select("book_id", F.md5("description").alias("h"))
    return order.with_group_count(b, ["h"], "desc_group_size").select("book_id", "desc_group_size")


@query
def dedupe_summary(spark, sf_dir):
    b = books(spark, sf_dir)
    out = profile.dedupe_summary(b, resolve.clean_books(b))
    return one_row(spark, **{k: round(v, 4) if isinstance(v, float) else v for k, v in out.items()})


@query
def spearman(spark, sf_dir):
    return rounded(profile.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]))


@query
def numeric_spearman(spark, sf_dir):
    return rounded(profile.spearman(tracks(spark, sf_dir).features, [c for c in metadata.FEATURES if c != "year_norm"]))


@query
def dataset_manifest(spark, sf_dir):
    b = books(spark, sf_dir)
    return rounded(b.agg(F.count("*").alias("n_rows"), F.avg(T.placeholder_url(F.col("image_url")).cast("double")).alias("no_cover"), F.count_distinct(T.text_hash(F.col("description"))).alias("kinds")))


# Features


@query
def tfidf_corpus(spark, sf_dir):
    return lexical.corpus(books(spark, sf_dir)).select("book_id", F.col("flagged").alias("flag"), F.size("words").alias("tokens"), F.md5(F.array_join("words", " ")).alias("h"))


def lexical_fit(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    words = lexical.corpus(books(spark, sf_dir))
    counts = scratch(lexical.term_counts(words), "terms")
    return words, counts, lexical.fit(counts, words.count())


@query
def tfidf_vocabulary(spark, sf_dir):
    return lexical_fit(spark, sf_dir)[2].select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_weights(spark, sf_dir):
    _, counts, vocabulary = lexical_fit(spark, sf_dir)
    w = lexical.weights(counts, vocabulary)
    return w.groupBy("book_id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 5).alias("total"), F.round(F.max("w"), 6).alias("top"))


@query
def tfidf_transform(spark, sf_dir):
    """Every fifth book under a vocabulary fitted on the others."""
    b = books(spark, sf_dir)
    old = b.where("book_id % 5 <> 0")
    counts = scratch(lexical.term_counts(lexical.corpus(old)), "terms")
    new = lexical.transform(b.where("book_id % 5 = 0"), lexical.fit(counts, old.count()))
    return new.select("book_id", F.size("ids").alias("terms"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query
def tfidf_top_terms(spark, sf_dir):
    _, counts, vocabulary = lexical_fit(spark, sf_dir)
    return lexical.top_terms(lexical.weights(counts, vocabulary))


@query
def tfidf_sparsity(spark, sf_dir):
    words, counts, vocabulary = lexical_fit(spark, sf_dir)
    v = lexical.vectors(words, counts, vocabulary).select(F.size("ids").alias("n"))
    return rounded(v.agg(F.count("*").alias("n_rows"), F.avg("n").alias("mean_nnz"), F.avg((F.col("n") < 3).cast("double")).alias("ultra_sparse")))


@query
def tfidf_extremes(spark, sf_dir):
    v = lexical_fit(spark, sf_dir)[2].select("term", "df", F.round("idf", 6).alias("idf"))
    rare, common = v.orderBy("df", "term").limit(20), v.orderBy(F.desc("df"), "term").limit(20)
    return rare.select(F.lit("rare").alias("which"), "*").unionByName(common.select(F.lit("common").alias("which"), "*"))


@query
def semantic_corpus(spark, sf_dir):
    b = books(spark, sf_dir)
    return b.select("book_id", F.md5(embed.semantic_text(b)).alias("h"))


@query
def text_embedding(spark, sf_dir):
    """The offline encoder's vectors: length, and the share of places in use."""
    v = embed.embed_texts(books(spark, sf_dir))
    return v.select("book_id", F.size("v").alias("width"), F.round(diagnose.length_of(F.col("v")), 4).alias("length"))


@query
def cover_embedding(spark, sf_dir):
    """Covers through fetching, decoding, letterboxing and encoding; a made-up picture per address, every seventh unreadable."""

    def fetch(url: str) -> bytes:
        k = sum(url.encode()) % 97
        return b"broken" if k % 7 == 0 else b"P6 %d %d 255\n" % (8 + k % 5, 6 + k % 3) + bytes((k + i) % 256 for i in range(3 * (8 + k % 5) * (6 + k % 3)))

    found = embed.covers(books(spark, sf_dir), fetch)
    v = embed.embed_covers(found, embed.PixelEncoder, embed.read_ppm, side=32)
    return v.join(found.select("book_id", "key", "placeholder"), "book_id").select("book_id", "key", "placeholder", F.col("v").isNotNull().alias("has_cover"), F.size("v").alias("width"))


@query
def authors_iaf(spark, sf_dir):
    b = books(spark, sf_dir)
    return rounded(metadata.fit_authors(metadata.incidence(b), b.count()))


@query
def authors_weights(spark, sf_dir):
    b = books(spark, sf_dir)
    inc = metadata.incidence(b)
    return rounded(metadata.author_weights(inc, metadata.fit_authors(inc, b.count())))


def numerics(spark, sf_dir) -> DataFrame:
    raw = metadata.raw_numerics(books(spark, sf_dir))
    return metadata.transform_numerics(raw, metadata.fit_numerics(raw))


@query
def numeric_features(spark, sf_dir):
    return rounded(numerics(spark, sf_dir).select("book_id", *metadata.FEATURES))


@query
def numeric_variance(spark, sf_dir):
    return rounded(profile.variances(numerics(spark, sf_dir), metadata.FEATURES))


@query
def coverage_gates(spark, sf_dir):
    t = tracks(spark, sf_dir)
    n = t.counts()
    genre = B.coverage(t.books, genre_cache(spark, sf_dir))
    image = n["image"] / n["n"]
    return one_row(spark, image=round(image, 6), image_ok=recommend.gates(n)["image"], genre=round(genre, 6), genre_ok=genre >= 0.1, genre_usable=genre >= 0.05)


@query
def vector_health(spark, sf_dir):
    out = diagnose.vector_health(tracks(spark, sf_dir).features, "semantic")
    return one_row(spark, n=out["rows"], low=round(out["low"], 5), mid=round(out["median"], 5), high=round(out["high"], 5), near_zero=out["near_zero"])


@query
def norm_outliers(spark, sf_dir):
    f = tracks(spark, sf_dir).features
    return spark.createDataFrame([(t, round(diagnose.norm_outlier_share(f, t), 6)) for t in ("semantic", "image")], "track string, share double")


# Neighbours and fusion


@query
def lexical_topk(spark, sf_dir):
    words, counts, vocabulary = lexical_fit(spark, sf_dir)
    v = scratch(lexical.vectors(words, counts, vocabulary).select("book_id", F.col("ids").alias("tfidf_ids"), F.col("w").alias("tfidf_w")), "tfidf")
    return rounded(similarity.nearest(v, seeds(spark, sf_dir), "tfidf", 10))


@query
def cosine_dense_topk(spark, sf_dir):
    return rounded(similarity.nearest(vectors(spark, sf_dir).withColumnRenamed("v", "semantic"), seeds(spark, sf_dir), "semantic", 10))


@query
def cosine_sparse_topk(spark, sf_dir):
    b = books(spark, sf_dir)
    inc = metadata.incidence(b)
    v = metadata.author_vectors(b, inc, metadata.fit_authors(inc, b.count()))
    v = scratch(v.select("book_id", F.col("ids").alias("authors_ids"), F.col("w").alias("authors_w")), "authors")
    return rounded(similarity.nearest(v, seeds(spark, sf_dir), "authors", 10))


@query
def nearest_table(spark, sf_dir):
    return rounded(recommend.nearest_table(tracks(spark, sf_dir), seeds(spark, sf_dir), "semantic").drop("title"))


@query
def author_dominance(spark, sf_dir):
    t = tracks(spark, sf_dir)
    near = similarity.nearest(t.features, seeds(spark, sf_dir), "authors", 10)
    return rounded(diagnose.author_dominance(near, t.books))


@query
def rank_percentile(spark, sf_dir):
    _, r = ranked(spark, sf_dir)
    long = r.select("seed", "cand", F.explode(F.array(*[F.struct(F.lit(t).alias("track"), F.col(t).alias("s"), F.col(f"p_{t}").alias("pct")) for t in similarity.TRACKS])).alias("x"))
    long = long.where("x.s IS NOT NULL").select("seed", "cand", "x.track", "x.pct")
    top = F.sum(F.when(F.col("pct") > 0.9, F.col("cand")).otherwise(0)).alias("top_sum")
    return long.groupBy("seed", "track").agg(F.count("*").alias("n"), F.round(F.min("pct"), 6).alias("low"), F.round(F.max("pct"), 6).alias("high"), top)


@query
def fused_topk(spark, sf_dir):
    return rounded(picks(spark, sf_dir, 5)[2])


@query
def fused_topk_year_bias(spark, sf_dir):
    return rounded(picks(spark, sf_dir, 5, 0.02)[2])


@query
def fused_per_candidate(spark, sf_dir):
    """Weights renormalised over the tracks that seed and candidate both have."""
    t = tracks(spark, sf_dir)
    o = recommend.Options(mmr=False, caps=None, per_candidate=True)
    return rounded(recommend.recommend(t, seeds(spark, sf_dir), o))


@query
def year_resort(spark, sf_dir):
    t, _, p = picks(spark, sf_dir, 5)
    return rank.year_resort(p, t.features).select("seed", "cand", F.col("rk").alias("new_rk"))


@query
def contrib_explain(spark, sf_dir):
    _, r, p = picks(spark, sf_dir, 5)
    parts = recommend.contributions(p.withColumnRenamed("rk", "rank"), r, rank.DEFAULT_WEIGHTS)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("track"), F.col(f"{t}_part").alias("contrib")) for t in similarity.TRACKS])).alias("x")
    return rounded(parts.select("seed", "cand", F.col("rank").alias("rk"), pairs).select("seed", "cand", "rk", "x.track", "x.contrib"))


@query
def explain_table(spark, sf_dir):
    _, r, p = picks(spark, sf_dir, 5)
    return rounded(recommend.contributions(p.withColumnRenamed("rk", "rank"), r, rank.DEFAULT_WEIGHTS))


@query
def numeric_contrib(spark, sf_dir):
    t, _, p = picks(spark, sf_dir, 5)
    return rounded(recommend.numeric_contributions(p, t.features))


@query
def caps_greedy(spark, sf_dir):
    t, _, p = picks(spark, sf_dir, 20)
    return rank.enforce_caps(p.withColumnRenamed("rk", "rank").join(recommend.cap_keys(t.books), "cand"))


@query
def mmr_rerank(spark, sf_dir):
    r = recommend.best(tracks(spark, sf_dir), seeds(spark, sf_dir), [rank.DEFAULT_WEIGHTS], 4, mmr="reference", lam=0.95, space="semantic", digits=9)
    return r.select("seed", F.col("rk").alias("rank"), "cand")


@query
def mmr_standard(spark, sf_dir):
    """Re-ranking for variety over the larger of two similarities."""
    r = recommend.best(tracks(spark, sf_dir), seeds(spark, sf_dir), [rank.DEFAULT_WEIGHTS], 4, mmr="standard", lam=0.9, space="numerics|authors", digits=9)
    return r.select("seed", F.col("rk").alias("rank"), "cand")


@query
def recommend_chain(spark, sf_dir):
    """The whole chain: bias, re-ranking, re-sorting by year, caps."""
    o = recommend.Options(k=4, mmr=True, mmr_space="semantic", year_bias=0.02, year_resort=True)
    return rounded(recommend.recommend(tracks(spark, sf_dir), seeds(spark, sf_dir), o))


@query
def serve_final(spark, sf_dir):
    return rounded(recommend.serve(tracks(spark, sf_dir), seeds(spark, sf_dir), rank.DEFAULT_WEIGHTS))


# Genres, evaluation, tuning


@query
def coarse_genres(spark, sf_dir):
    return evaluate.coarse_genres(genre_cache(spark, sf_dir)).select("book_id", F.array_join("combo", "|").alias("combo"))


@query
def taxonomy_order(spark, sf_dir):
    """Categories of texts that many markers fit: every marker itself, and pairs of neighbours."""
    t = evaluate.taxonomy(spark).select("needle", F.concat("needle", F.lit(" / "), F.reverse("needle")).alias("both"))
    return t.select("needle", evaluate.coarse(F.col("needle")).alias("c"), evaluate.coarse(F.col("both")).alias("c2"))


@query
def igf_combo(spark, sf_dir):
    return rounded(evaluate.igf_weights(evaluate.coarse_genres(genre_cache(spark, sf_dir))).withColumnRenamed("key", "combo"))


@query
def igf_genre(spark, sf_dir):
    return rounded(evaluate.igf_weights(evaluate.coarse_genres(genre_cache(spark, sf_dir)), "genre"))


def combos(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = scratch(evaluate.coarse_genres(genre_cache(spark, sf_dir)), "combos")
    return c, evaluate.igf_weights(c)


@query
def genre_at_k(spark, sf_dir):
    return rounded(evaluate.genre_at_k(picks(spark, sf_dir, 10)[2], *combos(spark, sf_dir)))


@query
def genre_at_k_single(spark, sf_dir):
    """Weighted by the mean weight of the common categories."""
    c = evaluate.coarse_genres(genre_cache(spark, sf_dir))
    return rounded(evaluate.genre_at_k(picks(spark, sf_dir, 10)[2], c, evaluate.igf_weights(c, "genre"), "genre"))


@query
def yearflag_at_k(spark, sf_dir):
    t, _, p = picks(spark, sf_dir, 10)
    return rounded(evaluate.yearflag_at_k(p, t.features))


@query
def rating_drift(spark, sf_dir):
    t, _, p = picks(spark, sf_dir, 10)
    return rounded(evaluate.rating_drift(p, t.features))


def settings_table(spark, settings: list[dict]) -> DataFrame:
    return spark.createDataFrame([(g, *[float(w.get(t, 0.0)) for t in similarity.TRACKS]) for g, w in enumerate(settings, 1)], "g int, " + ", ".join(f"{t} double" for t in similarity.TRACKS))


@query
def weight_grid(spark, sf_dir):
    return settings_table(spark, evaluate.weight_grid())


@query
def fine_sweep(spark, sf_dir):
    return rounded(settings_table(spark, evaluate.fine_sweep(rank.DEFAULT_WEIGHTS)).drop("g"), 3)


@query
def grid_eval(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return rounded(evaluate.evaluate(t, seeds(spark, sf_dir), evaluate.weight_grid(), *combos(spark, sf_dir)))


@query
def best_weights(spark, sf_dir):
    best, score = evaluate.select_weights(grid_eval(spark, sf_dir), evaluate.weight_grid())
    return one_row(spark, **best, score=score)


def variants(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    named = evaluate.ablations(rank.DEFAULT_WEIGHTS)
    return evaluate.seed_scores(tracks(spark, sf_dir), seeds(spark, sf_dir), list(named.values()), *combos(spark, sf_dir)), list(named)


@query
def ablation(spark, sf_dir):
    scores, names = variants(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, names)), F.col("g")).alias("setting")
    return rounded(scores.groupBy(label).agg(F.avg("genre").alias("genre"), F.avg("yearflag").alias("yearflag")))


@query
def mmr_on_off(spark, sf_dir):
    """The default setting's means without and with re-ranking."""
    t, s, c = tracks(spark, sf_dir), seeds(spark, sf_dir), combos(spark, sf_dir)
    both = evaluate.evaluate(t, s, [rank.DEFAULT_WEIGHTS], *c, k=4, mmr=True, plain=True)
    return rounded(both.select((F.col("g") == 2).alias("mmr"), "genre", "yearflag", "score"))


@query
def seed_winners(spark, sf_dir):
    scores, names = variants(spark, sf_dir)
    keep = [n for n in names if not n.startswith("no_")]
    rows = scores.where(F.element_at(F.array(*map(F.lit, names)), F.col("g")).isin(keep))
    return rounded(evaluate.seed_winners(rows, names))


@query
def worst_seeds(spark, sf_dir):
    scores = evaluate.seed_scores(tracks(spark, sf_dir), seeds(spark, sf_dir), [rank.DEFAULT_WEIGHTS], *combos(spark, sf_dir))
    return rounded(scores.select("seed", "yearflag")).orderBy("yearflag", "seed").limit(20)


@query
def group_eval(spark, sf_dir):
    t, s = tracks(spark, sf_dir), seeds(spark, sf_dir)
    scores = evaluate.seed_scores(t, s, [rank.DEFAULT_WEIGHTS], *combos(spark, sf_dir))
    odd = t.features.select(F.col("book_id").alias("seed"), F.when(F.col("pre_1900_flag") == 1, "outlier").otherwise("random").alias("seed_group"))
    return rounded(evaluate.group_report(scores, odd))


# Diagnostics


def lists(spark, sf_dir, k: int = 10) -> DataFrame:
    return diagnose.neighbour_lists(tracks(spark, sf_dir), seeds(spark, sf_dir), k)


@query
def jaccard_at_k(spark, sf_dir):
    return rounded(diagnose.jaccard_at_k(lists(spark, sf_dir)))


@query
def kendall_tau(spark, sf_dir):
    return rounded(diagnose.kendall_tau(lists(spark, sf_dir, 100), 100))


@query
def agreement(spark, sf_dir):
    return rounded(diagnose.agreement(lists(spark, sf_dir)))


@query
def agreement_messages(spark, sf_dir):
    return diagnose.agreement_messages(diagnose.agreement(lists(spark, sf_dir)))


@query
def uniqueness(spark, sf_dir):
    return rounded(diagnose.uniqueness(diagnose.agreement(lists(spark, sf_dir))))


@query
def diversity_hhi(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return rounded(diagnose.diversity(similarity.nearest(t.features, seeds(spark, sf_dir), "tfidf", 10), t.books))


@query
def diversity_messages(spark, sf_dir):
    out = diagnose.diversity_messages(diversity_hhi(spark, sf_dir))
    return one_row(spark, hhi=round(out["hhi"], 6), year_range=out["year_range"], authors=out["authors"], years=out["years"])


@query
def stability_md5(spark, sf_dir):
    return rounded(diagnose.stability(tracks(spark, sf_dir).features, seeds(spark, sf_dir), "semantic"))


@query
def random_seeds(spark, sf_dir):
    return evaluate.test_seeds(books(spark, sf_dir), 0.5, 50, 7)


@query
def positive_sets(spark, sf_dir):
    return diagnose.positive_sets(books(spark, sf_dir), seeds(spark, sf_dir))


@query
def negative_samples(spark, sf_dir):
    b, s = books(spark, sf_dir), seeds(spark, sf_dir)
    return diagnose.negative_samples(b, s, scratch(diagnose.positive_sets(b, s), "positives"))


@query
def separation_p95(spark, sf_dir):
    t, s = tracks(spark, sf_dir), seeds(spark, sf_dir)
    good = scratch(diagnose.positive_sets(t.books, s), "positives")
    bad = scratch(diagnose.negative_samples(t.books, s, good), "negatives")
    rows = [(x, *diagnose.separation(t.features, good, bad, x).values()) for x in ("semantic", "numerics")]
    return rounded(spark.createDataFrame(rows, "track string, threshold double, separation double"))


@query
def pair_masks(spark, sf_dir):
    """Numbers of ordered pairs with the same main author, the same description, and of all others."""
    b = books(spark, sf_dir)
    keys = diagnose.group_keys(b)
    pairs = keys.groupBy("kind", "k").agg(F.count("*").alias("n")).agg(
        F.sum(F.when(F.col("kind") == "a", F.col("n") * (F.col("n") - 1))).alias("same_author"), F.sum(F.when(F.col("kind") == "d", F.col("n") * (F.col("n") - 1))).alias("same_description"))
    n = b.count()
    return pairs.withColumn("other_author", F.lit(n * (n - 1)) - F.col("same_author"))


def measured_card(spark, sf_dir) -> list[dict]:
    t, s = tracks(spark, sf_dir), seeds(spark, sf_dir)
    good = scratch(diagnose.positive_sets(t.books, s), "positives")
    bad = scratch(diagnose.negative_samples(t.books, s, good), "negatives")
    names = ("semantic", "numerics")
    stable = {x: round(diagnose.stability(t.features, s, x).agg(F.avg("stability")).first()[0], 6) for x in names}
    separate = {x: round(diagnose.separation(t.features, good, bad, x)["separation"], 6) for x in names}
    unique = {r.track: round(r.uniqueness, 6) for r in diagnose.uniqueness(diagnose.agreement(diagnose.neighbour_lists(t, s, 10))).collect()}
    return diagnose.scorecard(stable, separate, unique)


CARD = "track string, baseline double, recommended double, stability double, separation double, uniqueness double"


@query
def scorecard(spark, sf_dir):
    return rounded(spark.createDataFrame([tuple(r.values()) for r in measured_card(spark, sf_dir)], CARD))


@query
def weight_deltas(spark, sf_dir):
    return rounded(spark.createDataFrame([(r["track"], r["delta"]) for r in diagnose.deltas(measured_card(spark, sf_dir))], "track string, delta double"))


@query
def seed_picker(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return diagnose.pick_seeds(t.books, t.features, 20)


@query
def interpretability_seeds(spark, sf_dir):
    return diagnose.interpretability_seeds(books(spark, sf_dir))


@query
def pca_2d(spark, sf_dir):
    """Variances of both projections and their covariance."""
    p = diagnose.principal_components(tracks(spark, sf_dir).features, "semantic").select(F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))
    return p.agg(F.count("*").alias("n"), F.round(F.covar_pop("x", "y"), 5).alias("cov"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return {name: sql for name, sql in SQL.items() if name in _QUERIES}
