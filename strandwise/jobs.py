"""Command-line jobs: reports on a catalogue, fitting all tracks, tuning and serving, export of the results.

python -m strandwise.jobs {eda,fit,hybrid} --csv BOOKS.csv --out FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features.bundle import Tracks, fit_or_load_all
from .operators import evaluate, profile, recommend, resolve
from .runtime import duration, init_logging, log, write_text
from .sources import books as B


def eda_reports(books: DataFrame, out: str) -> dict[str, str]:
    """The reports on a raw table: the table, its profile, nulls, lengths, vocabulary, three kinds of duplicates, author flips."""
    spark, out = books.sparkSession, out.rstrip("/")
    B.write_parquet(books, f"{out}/raw_books.parquet")
    B.write_json(spark, f"{out}/profile.json", profile.basic_profile(books))
    B.write_csv(profile.null_report(books).orderBy(F.desc("nulls")), f"{out}/null_report")
    B.write_csv(profile.description_length(books), f"{out}/desc_length")
    write_text(spark, f"{out}/vocab_size.txt", str(profile.vocabulary_size(books)))
    tables = {
        "dups_exact_title_authors": profile.exact_dups(books),
        "dups_same_description_groups": profile.same_description(books, by_hash=True),
        "dups_title_norm_author_overlap": profile.title_author_dups(books),
        "author_flip_candidates": author_flips(books),
    }
    for name, df in tables.items():
        B.write_csv(df, f"{out}/{name}")
    counts = {name: df.count() for name, df in tables.items() if name.startswith("dups")}
    B.write_json(spark, f"{out}/feature_actions.json", profile.feature_actions(books, counts))
    return {name: f"{out}/{name}" for name in tables}


def author_flips(books: DataFrame, k: int = 30) -> DataFrame:
    """The first k rows whose authors contain a comma."""
    return books.where(F.contains("authors", F.lit(","))).select("book_id", "title", "authors").orderBy("book_id").limit(k)


def select_weights(tracks: Tracks, cache: DataFrame, out: str, k: int = 10, mmr: bool = False, space: str = "tfidf|authors", most: int = 100) -> dict[str, float]:
    """The best of the 16 settings by the mean genre and era scores of test seeds; writes the table and the choice."""
    spark = cache.sparkSession
    combos = evaluate.coarse_genres(cache)
    settings = evaluate.weight_grid()
    means = evaluate.evaluate(tracks, evaluate.test_seeds(tracks.books, most=most), settings, combos, evaluate.igf_weights(combos), k, mmr, space=space)
    rows = [settings[r.g - 1] | {"genre": r.genre, "yearflag": r.yearflag, "score": r.score} for r in means.orderBy(F.desc(F.round("score", 9)), "g").collect()]
    B.write_json(spark, f"{out}/grid_eval_summary.json", rows)
    best = {t: rows[0][t] for t in settings[0]} if rows else dict(recommend.rank.DEFAULT_WEIGHTS)
    B.write_json(spark, f"{out}/weights_selected.json", best)
    return best


def export_metrics(spark: SparkSession, out: str, metrics: dict, config: dict) -> str:
    """The final measures and the settings they were made with, as one JSON file."""
    path = f"{out.rstrip('/')}/final_metrics.json"
    B.write_json(spark, path, {"metrics": metrics, "config": config})
    return path


def hybrid(books: DataFrame, out: str, provider=None, seed_id: int | None = None, **tracks_options) -> dict:
    """Clean, fit, tune, recommend: writes the list of one seed (the first book unless given) as CSV and JSON."""
    spark, out = books.sparkSession, out.rstrip("/")
    with duration("clean"):
        clean = resolve.ensure_clean(books)
    with duration("fit"):
        tracks = fit_or_load_all(clean, f"{out}/tracks", **tracks_options)
    cache = B.ensure_genre_cache(tracks.books, f"{out}/genre_cache", provider or (lambda title, authors: []))
    log.info("genre cache covers %.3f", B.coverage(tracks.books, cache))
    with duration("tune"):
        best = select_weights(tracks, cache, out)
    if seed_id is None:
        seed_id = tracks.books.agg(F.min("book_id")).first()[0]
    picks = recommend.serve(tracks, spark.createDataFrame([(seed_id,)], "seed long"), best)
    rows = picks.join(tracks.books.select(F.col("book_id").alias("cand"), "title", "authors", "original_publication_year", "average_rating"), "cand").orderBy("rank")
    B.write_csv(rows, f"{out}/top5_{seed_id}")
    result = {"seed_book_id": seed_id, "weights": best, "picked": [r.asDict() for r in rows.collect()]}
    B.write_json(spark, f"{out}/top5_{seed_id}.json", result)
    export_metrics(spark, out, {"coverage": B.coverage(tracks.books, cache)}, tracks.manifest)
    return result


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("job", choices=["eda", "fit", "hybrid"])
    p.add_argument("--csv", required=True)
    p.add_argument("--out", default="artifacts")
    a = p.parse_args(args)
    init_logging()
    spark = SparkSession.builder.getOrCreate()
    books = B.read_csv(spark, a.csv)
    if a.job == "eda":
        eda_reports(books, a.out)
    elif a.job == "fit":
        fit_or_load_all(books, a.out)
    else:
        hybrid(books, a.out)


if __name__ == "__main__":
    main()
