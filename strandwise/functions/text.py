"""Text normalisation as Column expressions; all stay in the JVM but ascii_fold and normal_form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import ship
from .stopwords import ENGLISH, STRICT

# Texts of a known disclaimer, and the weights and scales of the language flag.
DISCLAIMER, DISCLAIMER_END = r"not\s+the\s+actual\s+book", r"full copy of this great book\."
WEIGHTS, SHARE_SCALE, SHORT_SHARE, RATIO_SCALE, FLAG_AT, LEAST_WORDS = (0.7, 0.3), 0.98, 0.63, 0.40, 0.7, 30

#: The last year that is not in the future for the cleaning rules.
LAST_YEAR = 2026


def collapse_ws(c: Column) -> Column:
    """Fold runs of Unicode white space and trim; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def typography(c: Column) -> Column:
    """Straight quotes, plain dashes, no control characters, folded white space."""
    straight = F.translate(F.coalesce(c, F.lit("")), "‘’“”–— ", "''\"\"-- ")
    return collapse_ws(F.regexp_replace(straight, r"[\x00-\x1F\x7F]", " "))


def trim_disclaimer(c: Column) -> Column:
    """Drop a known disclaimer through its first end mark, if both of its marks are there."""
    both = c.rlike("(?i)" + DISCLAIMER) & c.rlike("(?i)" + DISCLAIMER_END)
    return F.when(both, F.regexp_replace(c, rf"(?is)^.*?{DISCLAIMER_END}\s*", "")).otherwise(c)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def author_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def canonical_author(c: Column) -> Column:
    """'Last, First' to 'First Last' if there is just one comma and one person."""
    flat = collapse_ws(c)
    one = (F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit(""))) == 1) & ~F.lower(flat).rlike(" & | and ")
    return F.when(one, F.regexp_replace(flat, r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", "$2 $1")).otherwise(flat)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))


def stopword_share(tokens: Column, words=tuple(STRICT)) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words))) / F.greatest(F.lit(1), F.size(tokens))


def non_ascii_ratio(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\p{L}]|[A-Za-z]", "")) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def suspected_non_english(c: Column, words=tuple(STRICT)) -> Column:
    """Flag from the stop-word share (of 30 words or more) and the share of letters outside ASCII."""
    c = F.coalesce(c, F.lit(""))
    tokens = word_tokens(c)
    share = F.when(F.size(tokens) >= LEAST_WORDS, (1 - stopword_share(tokens, words)) / F.lit(SHARE_SCALE)).otherwise(F.lit(SHORT_SHARE))
    return F.lit(WEIGHTS[0]) * share + F.lit(WEIGHTS[1]) * (non_ascii_ratio(c) / F.lit(RATIO_SCALE)) >= F.lit(FLAG_AT)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def normal_form(c: Column) -> Column:
    """NFKC (Spark has no such function)."""
    ship()
    return _nfkc(c)


def ascii_fold(c: Column) -> Column:
    """NFKD without what is not ASCII."""
    ship()
    return _fold(c)


def text_hash(c: Column, nfkc: bool = True) -> Column:
    """64-bit hex digest of the folded text; equal for equal texts (and, with nfkc, for compatible spellings)."""
    c = F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(collapse_ws(normal_form(c) if nfkc else c), 256), 1, 16)


def tfidf_title(c: Column) -> Column:
    """Accents folded, lower case, letters only."""
    folded = F.lower(ascii_fold(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"[^a-z]+", " "))


def tfidf_words(c: Column, words=tuple(ENGLISH)) -> Column:
    """The words of a cleaned text without stop words."""
    return F.filter(F.split(tfidf_title(c), " "), lambda t: (t != "") & ~t.isin(*words))


def tfidf_description(c: Column, words=tuple(ENGLISH)) -> Column:
    return F.array_join(tfidf_words(c, words), " ")


def word_count(c: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def known_year(c: Column, last: int = LAST_YEAR) -> Column:
    return F.when(c <= last, c)


def placeholder_url(c: Column) -> Column:
    return c.isNull() | (c == "") | F.contains(F.lower(F.trim(c)), F.lit("nophoto"))


def cover_html(url: Column, width: int = 120) -> Column:
    """An image tag for a cover; empty without one."""
    return F.when(placeholder_url(url), F.lit("")).otherwise(F.concat(F.lit('<img src="'), F.replace(url, F.lit('"'), F.lit("&quot;")), F.lit(f'" width="{width}">')))


def decade(c: Column) -> Column:
    return (F.floor(c / 10) * 10).cast("long")
