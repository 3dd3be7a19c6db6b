"""Lexical track: TF-IDF of words and pairs of neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..runtime import scratch, ship


@dataclass(frozen=True)
class Params:
    """Numbers below 1 that are floats are shares of the books, integers are counts."""

    pairs: bool = True
    min_df: int | float = 5
    max_df: int | float = 0.90
    max_features: int = 120_000
    sublinear: bool = True
    title_boost: int = 2
    blank_flagged: bool = True


def corpus(books: DataFrame, params: Params = Params()) -> DataFrame:
    """(book_id, flagged, words): the title's words `title_boost` times, then the description's; flagged ones are left out."""
    flag = F.col("desc_suspected_non_english") if "desc_suspected_non_english" in books.columns else T.suspected_non_english(F.col("description"))
    books = books.select("book_id", "title", "description", F.coalesce(flag, F.lit(False)).alias("flagged"))
    title = F.filter(F.split(T.tfidf_title(F.col("title")), " "), lambda t: t != "")
    body = T.tfidf_words(F.when(F.col("flagged") & F.lit(params.blank_flagged), F.lit("")).otherwise(F.col("description")))
    words = books.select("book_id", "flagged", title.alias("t"), body.alias("d"))
    return words.select("book_id", "flagged", F.concat(*[F.col("t")] * max(1, params.title_boost), F.col("d")).alias("words"))


def blanked_share(words: DataFrame) -> float:
    return words.agg(F.avg(F.col("flagged").cast("double"))).first()[0] or 0.0


def term_counts(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(book_id, term, c). Words move once, by book; everything after that finds a book's terms in one place."""
    n = F.size("words")
    both = F.zip_with(F.slice("words", 1, F.greatest(n - 1, F.lit(0))), F.slice("words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = F.concat("words", both) if params.pairs else F.col("words")
    return words.repartition("book_id").select("book_id", F.explode(terms).alias("term")).groupBy("book_id", "term").agg(F.count("*").alias("c"))


def _bound(limit: int | float, n: int) -> float:
    return limit * n if isinstance(limit, float) else limit


def fit(counts: DataFrame, n: int, params: Params = Params()) -> DataFrame:
    """The vocabulary (term, df, cf, idf): terms in enough and not too many of the n books, the most frequent ones."""
    return _vocabulary(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("cf")), n, params)


def _top(seen: DataFrame, n: int, params: Params) -> DataFrame:
    seen = seen.where((F.col("df") >= _bound(params.min_df, n)) & (F.col("df") <= _bound(params.max_df, n)))
    return seen.orderBy(F.desc("cf"), "term").limit(params.max_features)


def _vocabulary(seen: DataFrame, n: int, params: Params) -> DataFrame:
    return scratch(_top(seen, n, params).withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1), "vocabulary")


def _by_book(counts: DataFrame, vocabulary: DataFrame, params: Params) -> DataFrame:
    """(book_id, v, size): each book's terms with raw weights, and their length. The vocabulary is broadcast: it has at
    most max_features terms. A book's terms are bounded by its text."""
    tf = 1 + F.log("c") if params.sublinear else F.col("c").cast("double")
    raw = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").select("book_id", "term", (tf * F.col("idf")).alias("w"))
    return raw.groupBy("book_id").agg(F.collect_list(F.struct("term", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))


def weights(counts: DataFrame, vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """(book_id, term, w) with rows of length 1; terms outside the vocabulary are ignored."""
    one = _by_book(counts, vocabulary, params).select("book_id", "size", F.explode("v").alias("x"))
    return one.select("book_id", F.col("x.term").alias("term"), (F.col("x.w") / F.col("size")).alias("w"))


def vectors(words: DataFrame, counts: DataFrame, vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """(book_id, ids, w) of every book, terms by their 64-bit hash; a book without terms has empty lists."""
    one = _by_book(counts, vocabulary, params)
    rows = one.select("book_id", F.transform("v", lambda x: F.xxhash64(x["term"])).alias("ids"), F.transform("v", lambda x: x["w"] / F.col("size")).alias("w"))
    none = {"ids": F.array().cast("array<long>"), "w": F.array().cast("array<double>")}
    return words.select("book_id").join(rows, "book_id", "left").select("book_id", *[F.coalesce(c, e).alias(c) for c, e in none.items()])


#: Distinct terms whose partial counts a task holds before it passes them on.
HELD = 400_000
#: Books whose terms or vectors move at once in a fit; more of them are gone through in slices, SLICES at most, so that
#: a growing table is not read more and more often.
SLICE, SLICES = 60_000, 8
#: Word lists that a task works on at once.
LISTS = 1_000


def slices(n: int) -> int:
    return max(1, min(SLICES, -(-n // SLICE)))


def kept_corpus(books: DataFrame, params: Params = Params()) -> DataFrame:
    """corpus() on disk with slice, a number below slices() that the id decides; each slice has its own files."""
    n = slices(books.count())
    return scratch(corpus(books, params).withColumn("slice", F.pmod(F.xxhash64("book_id"), F.lit(n)).cast("int")), "corpus", "slice")


def _lists(batches) -> Iterator[pa.RecordBatch]:
    """The rows, LISTS at a time; what Arrow keeps of freed memory is given back in between, as workers live on."""
    for b in batches:
        for lo in range(0, b.num_rows, LISTS):
            yield b.slice(lo, LISTS)
            pa.default_memory_pool().release_unused()


def _batch_terms(words: pa.Array, pairs: bool, part: int = 0, parts: int = 1) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, and row, place of the term, count for each term of each row) of a column of word lists.

    Of several parts only one's terms are counted; a term's text up to the first space decides its part.
    """
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    coded = words.flatten().dictionary_encode()
    kinds, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    terms = kinds
    mine = np.ones(len(code), bool)
    if parts > 1:
        mine = np.array([zlib.crc32(x.split(" ", 1)[0].encode()) % parts == part for x in kinds.to_pylist()], bool)[code]
    if pairs and len(code):
        near = np.flatnonzero((row[1:] == row[:-1]) & mine[:-1])
        both, two = np.unique(code[near] * len(kinds) + code[near + 1], return_inverse=True)
        joined = pc.binary_join_element_wise(kinds.take(pa.array(both // len(kinds))), kinds.take(pa.array(both % len(kinds))), " ")
        row, code, terms = np.r_[row[mine], row[near]], np.r_[code[mine], two + len(kinds)], pa.concat_arrays([kinds, joined])
    else:
        row, code = row[mine], code[mine]
    key, c = np.unique(row * max(1, len(terms)) + code, return_counts=True)
    return terms, key // max(1, len(terms)), key % max(1, len(terms)), c


def _stats(batches, pairs: bool, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of this task's rows and one part of the terms; a term may come more than once."""
    held, n = [], 0

    def merged():
        t = pa.concat_tables(held).group_by("term").aggregate([("df", "sum"), ("cf", "sum")])
        return pa.table({"term": t["term"], "df": t["df_sum"], "cf": t["cf_sum"]})

    for b in _lists(batches):
        terms, _, at, c = _batch_terms(b.column("words"), pairs, part, parts)
        found = pa.table({"term": terms, "df": np.bincount(at, minlength=len(terms)), "cf": np.bincount(at, weights=c, minlength=len(terms)).astype(np.int64)})
        held.append(found.filter(pc.greater(found["df"], 0)))
        n += held[-1].num_rows
        if n > HELD:
            held = [merged()]
            n = held[0].num_rows
            if n > HELD // 2:
                yield from held[0].to_batches(max_chunksize=10_000)
                held, n = [], 0
    if held:
        held = [merged()]
        yield from held[0].to_batches(max_chunksize=10_000)
        held.clear()
        pa.default_memory_pool().release_unused()


def fit_words(words: DataFrame, n: int, params: Params = Params()) -> DataFrame:
    """The vocabulary as fit() gives it, from the word lists of books with distinct ids: only partial counts move.

    The terms of many books are counted slice by slice, so that only one slice's counts are on disk at once.
    """
    ship(words.sparkSession)
    parts, out = slices(n), None
    for k in range(parts):
        part = words.select("words").mapInArrow(lambda it, k=k: _stats(it, params.pairs, k, parts), "term string, df long, cf long")
        seen = part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        seen = scratch(_top(seen, n, params), "terms") if parts > 1 else seen
        out = seen if out is None else out.unionByName(seen)
    return _vocabulary(out, n, params)


def _weigh(batches, sent, params: Params) -> Iterator[pa.RecordBatch]:
    terms, ids, idf = sent.value
    for b in _lists(batches):
        words = b.column("words")
        kinds, row, at, c = _batch_terms(words, params.pairs)
        known = pc.fill_null(pc.index_in(kinds, value_set=terms), -1).to_numpy(zero_copy_only=False)[at]
        row, known, c = row[known >= 0], known[known >= 0], c[known >= 0]
        w = (1 + np.log(c) if params.sublinear else c.astype(float)) * idf[known]
        size = np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32))
        none = words.is_null() if words.null_count else None
        lists = [pa.ListArray.from_arrays(ends, pa.array(x), mask=none) for x in (ids[known], w / size[row])]
        kept = [c for c in b.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *lists], [*kept, "ids", "w"])


def vectors_of_words(words: DataFrame, vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns beside words, and the vectors() of the word lists, without moving them; null lists have null ones."""
    spark = words.sparkSession
    ship(spark)
    known = vocabulary.select("term", "idf", F.xxhash64("term").alias("id")).toArrow().combine_chunks()
    column = lambda c: known.column(c).chunk(0) if known.num_rows else pa.array([], known.schema.field(c).type)
    sent = spark.sparkContext.broadcast((column("term"), column("id").to_numpy(), column("idf").to_numpy()))
    kept = [f for f in words.schema.fields if f.name != "words"]
    out = StructType([*kept, StructField("ids", ArrayType(LongType())), StructField("w", ArrayType(DoubleType()))])
    return words.mapInArrow(lambda it: _weigh(it, sent, params), out)


def transform(books: DataFrame, vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """Vectors of new rows under a fitted vocabulary; the same rows as in the fit get the same vectors."""
    words = corpus(books, params)
    return vectors(words, term_counts(words, params), vocabulary, params)


def top_terms(weighted: DataFrame, k: int = 15) -> DataFrame:
    """(book_id, term, rk): the k heaviest terms of each book. A book's terms are bounded by its text."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("o"), "term"))), 1, k)
    rows = weighted.where("w > 0").groupBy("book_id").agg(best.alias("best"))
    return rows.select("book_id", F.posexplode("best").alias("p", "x")).select("book_id", F.col("x.term").alias("term"), (F.col("p") + 1).alias("rk"))
