"""Reports on a catalogue table: missing values, profiles, shapes of distributions, duplicates, and what they advise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH
from ..runtime import scratch
from .order import quantiles, running, with_group_count

NUMERIC, CATEGORICAL = ["original_publication_year", "average_rating"], ["language_code", "authors", "image_url"]
# The characters that are usual in titles and descriptions.
USUAL = r"a-zA-Z0-9\s\.,:;!?'\-\(\)\[\]/&"


def null_report(df: DataFrame) -> DataFrame:
    """(column_name, nulls, total, pct): one pass over the table."""
    row = df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"n_{k}") for k, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n_{k}").alias("n")) for k, c in enumerate(df.columns)])
    out = row.select("total", F.explode(pairs).alias("x")).select(F.col("x.c").alias("column_name"), (F.col("total") - F.col("x.n")).alias("nulls"), "total")
    return out.withColumn("pct", F.round(F.col("nulls") / F.nullif("total", F.lit(0)), 4))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, std, low, q1, mid, q3, high) of numeric columns: one pass, and a counted order per column for the quartiles."""
    aggs = [f(c).alias(f"{n}_{k}") for k, c in enumerate(columns) for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max))]
    row = df.agg(*aggs).first()
    rows = []
    for k, c in enumerate(columns):
        q = quantiles(df, F.col(c), [0.25, 0.5, 0.75])
        rows.append((c, row[f"n_{k}"], row[f"mean_{k}"], row[f"std_{k}"], *[None if x is None else float(x) for x in (row[f"low_{k}"], *q, row[f"high_{k}"])]))
    return df.sparkSession.createDataFrame(rows, "column_name string, n long, mean double, std double, low double, q1 double, mid double, q3 double, high double")


def top_values(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n): counts of all values with null, the most frequent first; all or the first k."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if k is None else out.limit(k)


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, kinds, top, freq) of text columns: values are counted once, for all columns in one plan."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x"))
    counts = rows.select("x.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count("*").alias("c"))
    out = counts.groupBy("column_name").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("c", "v")).alias("m"), F.max("c").alias("freq"))
    first = counts.join(out.select("column_name", F.col("freq").alias("c")), ["column_name", "c"]).groupBy("column_name").agg(F.min("v").alias("top"))
    return out.join(first, "column_name").select("column_name", "n", "kinds", "top", "freq")


def describe_all(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Both profiles as one table."""
    return numeric_profile(df, numeric).join(categorical_profile(df, categorical), ["column_name", "n"], "full_outer")


def basic_profile(df: DataFrame) -> dict:
    """rows, cols, dtypes, numeric_summary and categorical_cardinality."""
    numeric = [r.asDict() for r in numeric_profile(df, NUMERIC).collect()] if set(NUMERIC) <= set(df.columns) else []
    kinds = {r.column_name: r.kinds for r in categorical_profile(df, [c for c in CATEGORICAL if c in df.columns]).collect()}
    return {"rows": df.count(), "cols": len(df.columns), "dtypes": dict(df.dtypes), "numeric_summary": {r.pop("column_name"): r for r in numeric}, "categorical_cardinality": kinds}


def histogram(df: DataFrame, value: Column, low: float, width: float) -> DataFrame:
    """(bin, n) of fixed-width bins; nulls are the null bin."""
    return df.groupBy(F.floor((value - F.lit(low)) / F.lit(width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def unusual_chars(df: DataFrame, column: str = "title", k: int = 30) -> DataFrame:
    """(ch, n): the most frequent characters outside the usual ones."""
    chars = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"([^{USUAL}])"), F.lit(1))
    return df.select(F.explode(chars).alias("ch")).groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(k)


def vocabulary_size(df: DataFrame, column: str = "description", approximate: bool = False) -> int:
    """Distinct words of two characters or more (letters, digits, low line), without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))
    rows = df.select(F.explode(F.array_distinct(words)).alias("w")).where(~F.col("w").isin(*ENGLISH))
    return rows.agg((F.approx_count_distinct if approximate else F.count_distinct)("w")).first()[0]


def description_length(df: DataFrame, column: str = "description") -> DataFrame:
    """(book_id, desc_len): words of letters."""
    return df.select("book_id", F.size(T.word_tokens(F.col(column))).alias("desc_len"))


def nan_ratio(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double"))


def unique_ratio(df: DataFrame, column: str) -> float:
    """Distinct values (null is one) by rows."""
    row = df.groupBy(column).agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).first()
    return row.kinds / row.n if row.n else 0.0


def top_share(df: DataFrame, column: str, k: int = 1) -> float:
    """Share of the rows that have one of the k most frequent values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    top, total = counts.orderBy(F.desc("n")).limit(k).agg(F.sum("n")).first()[0], df.count()
    return (top or 0) / total if total else 0.0


def shape(df: DataFrame, value: Column) -> dict:
    """n, skew and excess kurtosis of the population (null for fewer than 10 values)."""
    row = df.select(value.cast("double").alias("x")).agg(F.count("x").alias("n"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt")).first()
    return {"n": row.n, "skew": row.skew if row.n >= 10 else None, "kurt": row.kurt if row.n >= 10 else None}


def gini(df: DataFrame, value: Column) -> float | None:
    """Gini coefficient; negative values are shifted to 0 first. Values are counted, then ranked over ranges."""
    counts = df.select(value.cast("double").alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    at = scratch(running(counts, ["x"], F.col("c")), "counts")
    n, low, total = at.agg(F.sum("c"), F.min("x"), F.sum(F.col("x") * F.col("c"))).first()
    if not n:
        return None
    shift = -low if low < 0 else 0.0
    total += shift * n
    if total == 0:
        return 0.0
    # A value of c rows after b others stands in the running sums of n - b, n - b - 1, ... rows.
    times = F.col("c") * (F.lit(n) - F.col("before")) - F.col("c") * (F.col("c") - 1) / 2
    weighted = at.agg(F.sum((F.col("x") + F.lit(shift)) * times)).first()[0]
    return (n + 1 - 2 * weighted / total) / n


def lognormalish(df: DataFrame, value: Column) -> dict:
    """Right-skewed (above 1) or unequal (Gini above 0.5)."""
    s, g = shape(df, value)["skew"], gini(df, value)
    return {"skew": s, "gini": g, "lognormalish": bool((s is not None and s > 1.0) or (g is not None and g > 0.5))}


def median_split(df: DataFrame, value: Column) -> Column:
    """1 where the value is above its median, else 0."""
    mid = quantiles(df, value, [0.5])[0]
    return F.coalesce(value > F.lit(mid), F.lit(False)).cast("int")


def feature_actions(df: DataFrame, duplicates: dict[str, int] | None = None) -> list[dict]:
    """What the distributions advise: (feature, action, why) by fixed rules."""
    out = []

    def advise(feature, action, why):
        out.append({"feature": feature, "action": action, "why": why})

    numeric = [c for c, t in df.dtypes if re.match(r"(tiny|small|big)?int|double|float|decimal", t)]
    ratios = df.agg(*[nan_ratio(c).alias(c) for c in numeric]).first() if numeric else {}
    for c in numeric:
        r = ratios[c] or 0.0
        advise(c, "consider_imputation" if r > 0.1 else "keep", f"{r:.2%} missing")
    if "language_code" in df.columns:
        share, kinds = top_share(df, "language_code"), unique_ratio(df, "language_code")
        advise("language_code", "drop" if share >= 0.50 else "keep_but_downweight", f"top_share={share:.3f}, unique_ratio={kinds:.3f}")
    if "description" in df.columns:
        words = T.word_count(F.col("description"))
        s, mid = lognormalish(df, words), quantiles(df, words, [0.5])[0]
        skew = "unknown" if s["skew"] is None else f"{s['skew']:.2f}"
        advise("desc_length", "derive_log1p_and_binary" if s["lognormalish"] else "zscore_and_binary", f"skew={skew}, median={mid}")
    if "authors" in df.columns:
        mid = quantiles(df, F.size(T.author_list(F.col("authors"))), [0.5])[0]
        advise("author_count", "derive_integer_and_binary", f"median={mid}")
    if "original_publication_year" in df.columns:
        year = F.col("original_publication_year")
        mid = quantiles(df, year, [0.5])[0]
        if mid is not None:
            advise("original_publication_year", "derive_decade_and_modern_flag", f"median={mid:.0f}")
    if "average_rating" in df.columns:
        lo, hi, std = df.agg(F.min("average_rating"), F.max("average_rating"), F.stddev_pop("average_rating")).first()
        if lo is not None:
            narrow = hi - lo <= 2.0 or std < 0.4
            advise("average_rating", "keep_raw_and_add_minmax_0_1" if narrow else "zscore", f"[{lo:.2f},{hi:.2f}], std={std:.2f}")
    if duplicates:
        some = sum(duplicates.values()) > 0
        advise("dedupe_policy", "apply_cleaning_rules_before_model" if some else "no_extra_dedupe_needed", str(duplicates))
    advise("__model_level__", "normalize_numeric_for_distance_models", "mixed features need comparable scales")
    return out


def exact_dups(books: DataFrame) -> DataFrame:
    """Rows whose title and authors occur more than once (nulls are alike), with the group's size."""
    rows = with_group_count(books, ["title", "authors"]).where("n > 1")
    return rows.select("title", "authors", "book_id", "original_publication_year", "average_rating", "n")


def same_description(books: DataFrame, least: int = 2, by_hash: bool = False) -> DataFrame:
    """Groups of rows with one description: size, sample of 80 characters, distinct titles, authors and years, ids.

    Descriptions are compared as they are (null is empty), or by their folded hash. The lists of a group grow with it;
    a group of n rows is reported as one row of n ids.
    """
    text = F.coalesce("description", F.lit(""))
    key = (F.col("desc_hash") if "desc_hash" in books.columns else T.text_hash(F.col("description"))) if by_hash else F.md5(text)
    year = F.col("original_publication_year").cast("int")
    rows = books.select("book_id", "title", "authors", text.alias("d"), year.alias("year"), key.alias("h"))
    many = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h")
    head = F.substring("d", 1, 80)
    sample = head if by_hash else F.when(F.length("d") > 80, F.concat(head, F.lit("…"))).otherwise(F.col("d"))
    return rows.join(many, "h").groupBy("h").agg(
        F.count("*").alias("n_rows"), F.min_by(sample, "book_id").alias("sample"), F.array_sort(F.collect_set("title")).alias("titles"),
        F.array_sort(F.collect_set("authors")).alias("authors"), F.array_sort(F.collect_set("year")).alias("years"), F.array_sort(F.collect_list("book_id")).alias("book_ids"),
    )


def title_author_dups(books: DataFrame) -> DataFrame:
    """(a, b): each book and the smallest one with its title key and one of its authors: a star per author and title
    instead of all pairs, so a hot title stays linear and the groups are the same."""
    from .resolve import author_overlap_edges

    return author_overlap_edges(books).select(F.col("b").alias("a"), F.col("a").alias("b")).where("a < b")


def dedupe_summary(before: DataFrame, after: DataFrame) -> dict:
    """Rows, and rows in duplicate groups by each rule, before and after cleaning, with the share removed (100 if there were none)."""
    out = {"rows_before": before.count(), "rows_after": after.count()}
    for name, rule in (("exact", lambda d: exact_dups(d).count()), ("overlap", lambda d: title_author_dups(d).count()), ("shared", lambda d: same_description(d).count())):
        a, b = rule(before), rule(after)
        out |= {f"{name}_before": a, f"{name}_after": b, f"{name}_removed_pct": max(0, a - b) / a * 100 if a else 100.0}
    return out


def variances(features: DataFrame, names: list[str], least: float = 1e-2) -> DataFrame:
    """(feature, variance, low) of numeric features, year_norm left out."""
    names = [n for n in names if n != "year_norm"]
    row = features.agg(*[F.var_samp(n).alias(n) for n in names])
    return row.unpivot([], names, "feature", "variance").withColumn("low", F.col("variance") < least)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, r): the mean rank of each value; values are counted, then ranked over ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("c"))
    return running(counts, ["value"], F.col("c")).select("value", (F.col("before") + (F.col("c") + 1) / 2).alias("r"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) of all pairs of columns; null where one is constant."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for k, c in enumerate(columns):
        ranks = average_ranks(df, c).select(F.col("value").alias(f"_v{k}"), F.col("r").alias(f"_r{k}"))
        rows = rows.join(ranks, F.col(c) == F.col(f"_v{k}"), "left")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    # merged partial aggregates of one value don't always give exactly 0
    spread = {k: F.when(F.min(f"_r{k}") < F.max(f"_r{k}"), F.stddev_pop(f"_r{k}")) for k in range(len(columns))}
    row = rows.agg(*[(F.covar_pop(f"_r{i}", f"_r{j}") / (spread[i] * spread[j])).alias(f"p{i}_{j}") for i, j in pairs])
    table = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"p{i}_{j}").alias("rho")) for i, j in pairs])
    return row.select(F.explode(table).alias("x")).select("x.*")


def run_manifest(clean: DataFrame) -> DataFrame:
    """One row: rows, share flagged as not English, share without a cover, distinct descriptions, share of shared ones."""
    return clean.agg(
        F.count("*").alias("n_rows"), (100 * F.avg(F.col("desc_suspected_non_english").cast("double"))).alias("non_en_pct"),
        (100 * F.avg(T.placeholder_url(F.col("image_url")).cast("double"))).alias("covers_missing_pct"), F.count_distinct("desc_hash").alias("desc_groups"),
        (100 * F.avg(F.col("desc_is_shared").cast("double"))).alias("desc_shared_pct"),
    )
