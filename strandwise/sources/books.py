"""Readers of the catalogue table: typed CSV with a column check, Parquet, genre caches, and a demonstration view."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import exists, write_text

SCHEMA = "book_id long, title string, authors string, original_publication_year double, language_code string, average_rating double, image_url string, description string"
REQUIRED = [c.split()[0] for c in SCHEMA.split(", ")]
# The texts that the usual data-frame library reads as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def check_columns(df: DataFrame) -> list[str]:
    """Required columns that are missing."""
    return [c for c in REQUIRED if c not in df.columns]


def read_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Typed scan of a catalogue; ValueError if a column is missing. Usual missing-value texts become null."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    head = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if gone := check_columns(head):
        raise ValueError(f"missing columns: {gone}")
    cols = []
    for c, kind in (x.split() for x in SCHEMA.split(", ")):
        text = F.when(~F.col(c).isin(MISSING), F.col(c))
        cols.append((text if kind == "string" else F.expr(f"try_cast(`{c}` AS double)").cast(kind)).alias(c))
    out = head.select(*cols)
    return out.limit(rows) if rows is not None else out


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with lists joined by "|"; one file per task (a sorted small report comes as one)."""
    cols = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def plain(value):
    """A value that JSON can hold: rows, numpy numbers and arrays, dates and sets become plain ones."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, list | tuple | set | frozenset):
        return [plain(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small result as one JSON file, by whatever file system the path names."""
    write_text(spark, path, json.dumps(plain(value), ensure_ascii=False, indent=2))


def write_json_rows(df: DataFrame, path: str) -> None:
    """A table as JSON lines."""
    df.write.mode("overwrite").json(path)


def payload_hash(df: DataFrame, column: str, key: str = "book_id") -> DataFrame:
    """(key, sha1) of one column's texts."""
    return df.select(key, F.sha1(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")).alias("sha1"))


def read_genre_cache(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, genres) of a JSON object from ids to lists; empty if the file is absent."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:  # an absent cache is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "book_id long, genres array<string>")
    pairs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "genres"))
    return pairs.select(F.col("k").cast("long").alias("book_id"), "genres")


def write_genre_cache(cache: DataFrame, path: str) -> None:
    """The cache as JSON lines {"book_id": ..., "genres": [...]}, written by all tasks."""
    cache.select("book_id", "genres").write.mode("overwrite").json(path)


def load_genre_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache that write_genre_cache() wrote; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "book_id long, genres array<string>")
    return spark.read.schema("book_id long, genres array<string>").json(path)


def coverage(books: DataFrame, cache: DataFrame) -> float:
    """Share of the books that the cache knows."""
    known = books.select("book_id").join(cache.select("book_id").distinct().withColumn("k", F.lit(1)), "book_id", "left")
    return known.agg(F.avg(F.col("k").isNotNull().cast("double"))).first()[0] or 0.0


def ensure_genre_cache(books: DataFrame, path: str, provider, most: int = 100) -> DataFrame:
    """The stored cache, or, if there is none, one hydrated for the first `most` books and stored."""
    spark = books.sparkSession
    cache = load_genre_cache(spark, path)
    if cache.isEmpty():
        write_genre_cache(hydrate(books, cache, provider, most), path)
        cache = load_genre_cache(spark, path)
    return cache


def subject_search(fetch_json, title: str, authors: str) -> list[str]:
    """Subjects of the first search result: its subject_facet, else its subject. fetch_json(parameters) returns a dict or None."""
    found = fetch_json({"title": title or "", "author": authors or "", "limit": 3})
    docs = (found or {}).get("docs") or []
    if not docs:
        return []
    return [s.strip() for s in docs[0].get("subject_facet") or docs[0].get("subject") or [] if isinstance(s, str) and s.strip()]


def volume_categories(fetch_json, title: str, authors: str) -> list[str]:
    """Categories of the first of three volumes that has any; a volume without any information ends the search."""
    found = fetch_json({"q": f'intitle:"{title or ""}"+inauthor:"{authors or ""}"', "maxResults": 3})
    for item in (found or {}).get("items") or []:
        info = item.get("volumeInfo")
        if not info:
            return []
        if got := [c.strip() for c in info.get("categories") or [] if isinstance(c, str) and c.strip()]:
            return got
    return []


class JsonSource:
    """fetch_json over HTTP for the two look-ups above; the address, and a key if one is needed, are the caller's."""

    def __init__(self, address: str, timeout: float = 8.0, extra: dict | None = None):
        self.address, self.timeout, self.extra = address, timeout, extra or {}

    def __call__(self, parameters: dict) -> dict | None:
        import urllib.parse
        import urllib.request

        try:
            with urllib.request.urlopen(f"{self.address}?{urllib.parse.urlencode(parameters | self.extra)}", timeout=self.timeout) as r:
                return json.load(r) if r.status == 200 else None
        except (OSError, ValueError):
            return None


def cache_misses(books: DataFrame, cache: DataFrame, most: int = 100) -> DataFrame:
    """The first `most` books by id that have no cached genres: what a provider is asked for next."""
    return books.join(cache, "book_id", "left_anti").orderBy("book_id").limit(most)


def hydrate(books: DataFrame, cache: DataFrame, provider, most: int = 100, pause: float = 0.0) -> DataFrame:
    """Cache plus what provider(title, authors) -> list finds for the next misses; empty finds are not kept."""
    def ask(batches):
        for pdf in batches:
            found = []
            for t, a in zip(pdf.title, pdf.authors, strict=True):
                found.append(list(provider(t, a)))
                time.sleep(pause)
            pdf["genres"] = found
            yield pdf[["book_id", "genres"]]

    new = cache_misses(books, cache, most).select("book_id", "title", "authors").mapInPandas(ask, "book_id long, genres array<string>")
    return cache.unionByName(new.where(F.size("genres") > 0))


def demo_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue made of the documents table, for the registered queries."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    return d.select(
        k.alias("book_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat("source", F.lit(", src"), (k % 7).cast("string")).alias("authors"),
        F.when(k % 11 != 0, (1850 + (k * 37) % 200).cast("double")).alias("original_publication_year"),
        F.col("lang").alias("language_code"),
        (1 + (F.col("n_chars") % 400) / F.lit(100.0)).alias("average_rating"),
        F.when(k % 7 == 2, F.lit("http://img.example/nophoto.png")).otherwise(F.concat(F.lit("http://img.example/"), k.cast("string"))).alias("image_url"),
        F.col("text").alias("description"),
    )
