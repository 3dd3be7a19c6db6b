"""All tracks of a catalogue as one table with a row per book, built or taken from the store."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import ensure_clean
from ..runtime import log, scratch
from . import embed, lexical, metadata
from .store import ArtifactStore, content_hash

TRACKS = ("tfidf", "semantic", "authors", "numerics", "image")


@dataclass
class Tracks:
    """features: book_id, <tfidf|authors>_ids and _w, semantic, numerics, image, the raw numeric features, year, rating.

    A row without a vector has null in that track; a track that is off is null everywhere. parts are the features of a
    new fit in slices: written one after the other, only one slice's word lists move at a time.
    """

    features: DataFrame
    books: DataFrame
    vocabulary: DataFrame | None = None
    iaf: DataFrame | None = None
    numeric_config: dict | None = None
    manifest: dict = field(default_factory=dict)
    parts: list[DataFrame] = field(default_factory=list)

    def counts(self) -> dict[str, int]:
        """Rows with a vector in each track, and rows in all."""
        row = self.features.agg(F.count("*").alias("n"), *[F.count(column(t)).alias(t) for t in TRACKS]).first()
        return row.asDict()


def column(track: str) -> str:
    return f"{track}_w" if track in ("tfidf", "authors") else track


def assemble(books: DataFrame, words: DataFrame | None, pairs: bool, numerics: bool, semantic: DataFrame | None, image: DataFrame | None, params: lexical.Params) -> Tracks:
    """Fit the tracks and join them, one row per book. words is lexical.kept_corpus; semantic and image are (book_id, v).

    The small tracks are joined first. The word lists, smaller than their vectors, move to them slice by slice.
    """
    n = books.count()
    out = Tracks(books.select("book_id"), books)
    rows = books.select("book_id")
    none = {"tfidf_ids": "array<long>", "tfidf_w": "array<double>", "authors_ids": "array<long>", "authors_w": "array<double>", "semantic": "array<float>", "numerics": "array<double>", "image": "array<float>"}
    if words is not None:
        out.vocabulary = lexical.fit_words(words, n, params)
    if pairs:
        inc = metadata.incidence(books)
        out.iaf = scratch(metadata.fit_authors(inc, n), "iaf")
        found = metadata.author_vectors(books, inc, out.iaf)
        rows = rows.join(found.select("book_id", F.col("ids").alias("authors_ids"), F.col("w").alias("authors_w")), "book_id", "left")
    if numerics:
        raw = scratch(metadata.raw_numerics(books), "raw")
        out.numeric_config = metadata.fit_numerics(raw)
        num = metadata.transform_numerics(raw, out.numeric_config)
        rows = rows.join(num.withColumn("numerics", metadata.numeric_vector()), "book_id", "left")
    for name, df in (("semantic", semantic), ("image", image)):
        if df is not None:
            rows = rows.join(df.select("book_id", F.col("v").cast("array<float>").alias(name)), "book_id", "left")
    missing = {c: F.lit(None).cast(t) for c, t in none.items() if c not in rows.columns and not (words is not None and c.startswith("tfidf"))}
    missing |= {c: F.lit(None).cast("double") for c in (*metadata.FEATURES, "year", "rating") if c not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    out.parts = [rows]
    if words is not None:
        count = lexical.slices(n)
        rows = scratch(rows, "tracks") if count > 1 else rows
        out.parts = []
        for k in range(count):
            mine = rows.where(F.pmod(F.xxhash64("book_id"), F.lit(count)) == k) if count > 1 else rows
            both = mine.join(words.where(F.col("slice") == k).select("book_id", "words"), "book_id", "left")
            made = lexical.vectors_of_words(both, out.vocabulary, params).withColumnsRenamed({"ids": "tfidf_ids", "w": "tfidf_w"})
            out.parts.append(made.select("book_id", "tfidf_ids", "tfidf_w", *[c for c in rows.columns if c != "book_id"]))
    out.features = reduce(DataFrame.unionByName, out.parts)
    return out


def fit_or_load_all(
    books: DataFrame,
    root: str,
    enable: dict[str, bool] | None = None,
    params: lexical.Params = lexical.Params(),
    text_encoder=embed.HashingEncoder,
    semantic: DataFrame | None = None,
    fetch=None,
    image: DataFrame | None = None,
    image_encoder=embed.PixelEncoder,
    decode=embed.read_ppm,
    force: bool = False,
    run_tag: str = "default",
) -> Tracks:
    """All tracks that are switched on, from the store under root if books and parameters are those of the last run.

    semantic and image may be given as (book_id, v); else texts pass through text_encoder, and covers through fetch
    (without it there is no image track), decode and image_encoder. A semantic or image track that fails is left out
    with a warning. Writes the manifests of the parts and manifest_all.
    """
    books = ensure_clean(books)
    store = ArtifactStore(books.sparkSession, f"{root.rstrip('/')}/{run_tag}")
    on = {t: True for t in TRACKS} | (enable or {})
    content = content_hash(books, "book_id", "title", "authors", "description", "average_rating", "original_publication_year", "image_url")
    config = {"lexical": asdict(params), "enable": on, "text_encoder": getattr(text_encoder, "__name__", "encoder"), "given": [semantic is not None, image is not None]}
    made: dict[str, Tracks] = {}

    def embedded(track, build):
        if not on[track]:
            return None
        try:
            return store.cached(track, content, config, build, force)
        except Exception as e:  # a track that can't be had is a track less
            log.warning("%s track skipped: %s", track, e)
            return None

    def build() -> Tracks:
        if "all" not in made:
            sem = embedded("semantic", lambda: semantic if semantic is not None else embed.embed_texts(books, text_encoder))
            img = None
            if image is not None or fetch is not None:
                img = embedded("image", lambda: image if image is not None else embed.embed_covers(embed.covers(books, fetch), image_encoder, decode))
            words = lexical.kept_corpus(books, params) if on["tfidf"] else None
            made["all"] = assemble(books, words, on["authors"], on["numerics"], sem, img, params)
        return made["all"]

    out = Tracks(store.cached("features", content, config, lambda: build().parts, force), books)
    if on["tfidf"]:
        out.vocabulary = store.cached("vocabulary", content, config, lambda: build().vocabulary, force)
    if on["authors"]:
        out.iaf = store.cached("iaf", content, config, lambda: build().iaf, force)
    if on["numerics"]:
        found = None if "all" in made else store.manifest("features")
        out.numeric_config = made["all"].numeric_config if "all" in made else (found or {}).get("numeric_config")
        if out.numeric_config is None:
            out.numeric_config = metadata.fit_numerics(metadata.raw_numerics(books))
    out.manifest = {"content": content, "params": config, "shapes": out.counts()}
    store.save_json("manifest_all", out.manifest)
    return out
