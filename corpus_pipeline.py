"""Corpus pipeline: toxic documents out, near copies out, repeated passages cut, benchmark text out, then packing."""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import decontaminate, near_dedup, packing, suffix_dedup, toxicity
from strandwise.llm.common import _delete, clear_scratch, owned, scratch_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Owner of the scratch tables of the stages, which are deleted when the next stage begins.
OWNER = "pipeline"


def stage(f):
    """A stage: what the stage before left in scratch goes (its result has been written), and its own tables are marked."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, OWNER)
        with owned(OWNER):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the machine is trained on labelled rows of its input.

    Null and empty texts score like any text without units and stay; repeated rows are each judged; without labels
    nothing is toxic; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.labelled(docs, labels))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id (of equal ids the one read first).

    Texts without words (null and empty ones too) are classes of their own and stay; an empty table gives an empty one.
    """
    out = near_dedup.near_duplicates(docs, carry=COLUMNS[1:])
    return out.where("keep").select("doc_id", *[F.col(f"carry_{c}").alias(c) for c in COLUMNS[1:]])


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 100 that start earlier; those of which nothing is left go.

    A text that was empty (or null) before stays, as an empty one; rows of one id are told apart; an empty table gives
    an empty one.
    """
    out = suffix_dedup.remove_repeats(docs, with_text=True, carry=["lang", "source"])
    out = out.where("n_removed = 0 OR length(trim(kept)) > 0")
    return out.select("doc_id", F.col("kept").alias("text"), F.col("carry_lang").alias("lang"), F.col("carry_source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts stay; an empty table gives an empty one."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; null and empty texts are their end token; an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: string kernels, byte-level repeats and the tokenizer cannot be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows are returned.

    A stage's table is deleted when the next one has been written; the last table stays, for the result reads it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        path = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
