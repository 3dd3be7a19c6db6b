"""Author and numeric tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import quantiles

# The numeric features in their order, and the bounds of the era flags.
FEATURES = ["desc_len_log1p", "desc_len_ge_median", "author_count_int", "author_single_flag", "average_rating_minmax", "year_norm", "modern_flag", "pre_1900_flag"]
MODERN_FROM, OLD_BEFORE = 2000, 1900


def author_column(books: DataFrame, canonical: bool = True):
    """The authors of a row as an array, by its author_list if it has one."""
    names = F.coalesce("author_list", F.array().cast("array<string>")) if "author_list" in books.columns else T.author_list(F.col("authors"))
    return F.transform(names, T.canonical_author) if canonical else names


def incidence(books: DataFrame, canonical: bool = True) -> DataFrame:
    """(book_id, author), once each."""
    return books.select("book_id", F.explode(F.array_distinct(author_column(books, canonical))).alias("author")).where("author <> ''")


def fit_authors(pairs: DataFrame, n: int) -> DataFrame:
    """(author, df, iaf) over n books."""
    seen = pairs.groupBy("author").agg(F.count("*").alias("df"))
    return seen.withColumn("iaf", F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)


def author_weights(pairs: DataFrame, iaf: DataFrame) -> DataFrame:
    """(book_id, author, w) with rows of length 1; unknown authors are ignored."""
    raw = pairs.join(iaf, "author").select("book_id", "author", "iaf")
    one = raw.groupBy("book_id").agg(F.collect_list(F.struct("author", "iaf")).alias("v"), F.sqrt(F.sum(F.col("iaf") * F.col("iaf"))).alias("size"))
    return one.select("book_id", "size", F.explode("v").alias("x")).select("book_id", F.col("x.author").alias("author"), (F.col("x.iaf") / F.col("size")).alias("w"))


def author_vectors(books: DataFrame, pairs: DataFrame, iaf: DataFrame) -> DataFrame:
    """(book_id, ids, w) of every book, authors by their 64-bit hash."""
    rows = author_weights(pairs, iaf).groupBy("book_id").agg(F.collect_list(F.struct(F.xxhash64("author").alias("i"), "w")).alias("v"))
    return books.select("book_id").join(rows, "book_id", "left").select("book_id", F.coalesce("v.i", F.array().cast("array<long>")).alias("ids"), F.coalesce("v.w", F.array().cast("array<double>")).alias("w"))


def changed_authors(books: DataFrame, examples: int = 10) -> tuple[float, DataFrame]:
    """Share of the rows that canonicalisation changes, and the first of them with both forms."""
    both = books.select("book_id", author_column(books, False).alias("before"), author_column(books).alias("after"))
    changed = F.col("before") != F.col("after")
    share = both.agg(F.avg(changed.cast("double"))).first()[0] or 0.0
    return share, both.where(changed).orderBy("book_id").limit(examples)


def raw_numerics(books: DataFrame) -> DataFrame:
    """(book_id, words, authors, rating, year) as the features use them."""
    names = books["author_list"] if "author_list" in books.columns else T.author_list(F.col("authors"))
    count = F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    rating, year = F.col("average_rating").cast("double"), F.col("original_publication_year").cast("double")
    return books.select("book_id", T.word_count(F.col("description")).alias("words"), count.alias("authors"), rating.alias("rating"), year.alias("year"))


def fit_numerics(raw: DataFrame, last_year: int = T.LAST_YEAR) -> dict:
    """Median of the word counts, range of the ratings and of the years up to last_year."""
    year = F.when(F.col("year").isNotNull(), F.least("year", F.lit(float(last_year))))  # least() skips nulls
    r0, r1, y0, y1 = raw.agg(F.min("rating"), F.max("rating"), F.min(year), F.max(year)).first()
    if r0 is None or r1 <= r0:
        r0, r1 = 0.0, 1.0
    if y0 is not None and y1 <= y0:
        y1 = y0 + 1.0
    return {"median_words": quantiles(raw, F.col("words"), [0.5])[0], "rating": [r0, r1], "year": [y0, y1], "last_year": last_year, "names": FEATURES}


def transform_numerics(raw: DataFrame, cfg: dict) -> DataFrame:
    """The eight features by name, beside book_id, year and rating; nulls become 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    clip = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    (r0, r1), (y0, y1) = cfg["rating"], cfg["year"]
    year = F.when(F.col("year").isNotNull(), F.least("year", F.lit(float(cfg["last_year"]))))
    share = lambda c, a, b: F.when(c.isNotNull(), clip((c - F.lit(a)) / F.lit(b - a))).otherwise(F.lit(0.0))
    values = [
        F.log1p("words"),
        flag(F.col("words") >= F.lit(cfg["median_words"])),
        F.col("authors").cast("double"),
        flag(F.col("authors") == 1),
        share(F.col("rating"), r0, r1),
        F.lit(0.0) if y0 is None else share(year, y0, y1),
        flag(F.col("year") >= MODERN_FROM),
        flag(F.col("year") < OLD_BEFORE),
    ]
    return raw.select("book_id", "year", "rating", *[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])


def numeric_vector():
    """The features as a vector of length 1 (a zero row stays zero)."""
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in FEATURES), F.lit(0.0)))
    return F.array(*[F.when(size > 0, F.col(c) / size).otherwise(F.lit(0.0)) for c in FEATURES])
