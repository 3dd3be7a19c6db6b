"""Entity resolution: books of one title that share authors, transitively, become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import scratch
from .order import with_group_count

#: Columns that cleaning adds.
CLEAN = ["author_list", "desc_suspected_non_english", "desc_hash", "desc_group_size", "desc_is_shared"]


def author_overlap_edges(books: DataFrame) -> DataFrame:
    """(a, b): each book and the smallest book that shares its title key and one of its authors (a star per author)."""
    names = books["author_list"] if "author_list" in books.columns else T.author_list(F.col("authors"))
    keyed = books.select("book_id", T.title_key(F.col("title")).alias("k"), F.explode(F.array_distinct(names)).alias("author"))
    low = keyed.groupBy("k", "author").agg(F.min("book_id").alias("b"))
    return keyed.join(low, ["k", "author"]).where("book_id <> b").select(F.col("book_id").alias("a"), "b").distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(book_id, root): smallest id reached over the edges; labels also jump to their label's label each round."""
    both = scratch(edges.union(edges.select("b", "a")).toDF("book_id", "other").distinct(), "edges")
    labels = scratch(vertices.select("book_id", F.col("book_id").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("book_id").alias("other"), "root"), "other").groupBy("book_id").agg(F.min("root").alias("m"))
        low = labels.join(near, "book_id", "left").select("book_id", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = labels.select(F.col("book_id").alias("root"), F.col("root").alias("next"))
        new = scratch(low.join(jump, "root").select("book_id", F.least("root", "next").alias("root"), "old"), "labels")
        if new.where("root <> old").isEmpty():
            return new.select("book_id", "root")
        labels = new.select("book_id", "root")


def consolidate(books: DataFrame) -> DataFrame:
    """One row per component: the earliest year's row (then the smallest id) with merged authors and the mean rating.

    A component without any year is led by its smallest id; rows without authors, and null titles, join nothing but
    rows with equal title keys that share an author. An empty table gives an empty result.
    """
    roots = scratch(components(books.select("book_id"), author_overlap_edges(books)), "roots")
    rest = [c for c in books.columns if c not in ("authors", "average_rating", "book_id")]
    year = F.col("original_publication_year")
    g = books.join(roots, "book_id").groupBy("root").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("book_id", "authors", *rest), F.struct(year.isNull(), year, "book_id")).alias("r"),
        F.avg("average_rating").alias("average_rating"),
    )
    many = g.where("n > 1").select("root")
    names = books.select("book_id", F.explode(T.author_list(F.col("authors"))).alias("author")).join(roots, "book_id").join(many, "root")
    merged = names.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("author")), ", ").alias("merged"))
    g = g.join(merged, "root", "left")
    authors = F.when(F.col("n") > 1, F.coalesce("merged", F.lit(""))).otherwise(F.col("r.authors"))
    return g.select("r.book_id", authors.alias("authors"), "average_rating", F.col("n").alias("merged_rows"), *[F.col(f"r.{c}").alias(c) for c in rest])


def clean_books(books: DataFrame, drop_language: bool = True, nfkc: bool = True) -> DataFrame:
    """The cleaning chain: trim, resolve, null future years, typography, disclaimer, language flag, description groups.

    Null texts become empty; all rows without a description share one group.
    """
    out = books.drop(*CLEAN)
    for c in ("title", "authors", "description"):
        out = out.withColumn(c, T.collapse_ws(F.col(c)))
    out = consolidate(out).drop("merged_rows")
    out = out.withColumn("author_list", T.author_list(F.col("authors"))).withColumn("original_publication_year", T.known_year(F.col("original_publication_year")))
    if drop_language and "language_code" in out.columns:
        out = out.drop("language_code")
    out = out.withColumn("title", T.typography(F.col("title"))).withColumn("description", T.trim_disclaimer(T.typography(F.col("description"))))
    out = out.withColumn("desc_suspected_non_english", T.suspected_non_english(F.col("description"))).withColumn("desc_hash", T.text_hash(F.col("description"), nfkc))
    out = with_group_count(scratch(out, "clean"), ["desc_hash"], "desc_group_size")
    return out.withColumn("desc_is_shared", F.col("desc_group_size") > 1)


def ensure_clean(books: DataFrame) -> DataFrame:
    """The table itself if it has all columns that cleaning adds, else the cleaned table."""
    return books if set(CLEAN) <= set(books.columns) else clean_books(books)
