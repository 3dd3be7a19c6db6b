"""Cross-entropy difference of two n-gram models with one vocabulary.

Tokens are the bytes of the text; all 256 are symbols of their own, and a start symbol stands before a text. The
target model counts the documents labelled good, the background model all documents; both have the same order,
vocabulary and interpolated Witten-Bell smoothing, and the background's counts are scaled to the target's mass, so
that both are smoothed alike. The score of a document is the mean over its tokens of target loss minus background
loss, in bits: below 0 it is more like the target.

Counts are distributed tables of the n-grams that occur. Texts lie in blocks; a block asks for its distinct n-grams
once, and the answers are joined to it, so neither the driver nor a task ever holds the whole model.
`symbols` and `model` are the dense form over few symbols, with which tests compare the smoothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucketed, buffers, chunks, parts_for, scratch, ship

VOCAB, ORDER = 48, 4
#: Symbols of the scored model: the start of a text and every byte.
SYMBOLS = 257
_BYTES = np.arange(1, SYMBOLS, dtype=np.int64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CHUNK = 4 << 20


def symbols(counts: dict[int, int], vocab: int = VOCAB) -> np.ndarray:
    """Symbol of each byte: 0 start of text, 1 white space, 2 ... the most frequent bytes, vocab - 1 all others."""
    out = np.full(256, vocab - 1, np.int32)
    for k, b in enumerate(sorted((b for b in counts if not _SPACE[b]), key=lambda b: (-counts[b], b))[: vocab - 3]):
        out[b] = k + 2
    out[_SPACE] = 1
    out = out[LOWER]
    return out


def grams(raw: np.ndarray, off: np.ndarray, table: np.ndarray, vocab: int = VOCAB, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of the n-gram that ends at each byte; before a text stand start symbols."""
    sym = table[raw]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    into = np.arange(len(raw)) - off[:-1][doc]
    code = sym.copy()
    for k in range(1, order):
        back = np.zeros_like(sym)
        back[k:] = sym[:-k] if k < len(sym) else 0
        back[into < k] = 0
        code += back * np.int32(vocab**k)
    return doc, code


def _block_counts(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Counts of a block's distinct n-grams, in its target documents and in all."""
    found = [np.zeros((0, 3), np.int64)]
    if docs.num_rows:
        raw, off = buffers(docs.column("text"))
        good = np.zeros(docs.num_rows, bool)
        if marks.num_rows:
            good = pc.is_in(docs.column("rid"), value_set=marks.column("gid").combine_chunks()).to_numpy().astype(bool)
        for lo, hi in chunks(off, _CHUNK):
            doc, code = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], _BYTES, SYMBOLS)
            at, n = np.unique(code, return_counts=True)
            t = np.zeros_like(n)
            if good[lo:hi].any():
                u, m = np.unique(code[good[lo:hi][doc]], return_counts=True)
                t[np.searchsorted(at, u)] = m
            found.append(np.c_[at, t, n])
    every = np.concatenate(found)
    code, into = np.unique(every[:, 0], return_inverse=True)
    t, b = (np.bincount(into, weights=every[:, k], minlength=len(code)).astype(np.int64) for k in (1, 2))
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    return pa.table({"block": pa.array(np.full(len(code), block, np.int64)), "code": pa.array(code), "target": pa.array(t), "background": pa.array(b)})


def model(codes: np.ndarray, counts: np.ndarray, scale: float, vocab: int = VOCAB, order: int = ORDER) -> np.ndarray:
    """log2 probability of every n-gram's last symbol given the others (dense, vocab ** order)."""
    p = np.full(1, 1.0 / vocab, np.float32)
    for k in range(1, order + 1):
        tail = codes % vocab**k
        c = np.bincount(tail, weights=counts, minlength=vocab**k).astype(np.float32).reshape(-1, vocab)
        kinds = (c > 0).sum(axis=1, keepdims=True).astype(np.float32)
        c *= np.float32(scale)
        mass = c.sum(axis=1, keepdims=True)
        # The shorter history of h is its last k - 2 symbols; p has one row for each.
        lower = np.tile(p.reshape(-1, vocab), (vocab, 1)) if k > 1 else np.full((1, vocab), p[0], np.float32)
        c += kinds * lower if k == 1 else kinds * lower[: len(c)]
        with np.errstate(invalid="ignore", divide="ignore"):
            c /= mass + kinds
        p = np.where(mass + kinds > 0, c, lower[: len(c)]).astype(np.float32).ravel()
    return np.log2(p)


def differences(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, diff, loss): target loss minus background loss, and background loss, in bits, of every n-gram of counts (code, target, background)."""
    total = counts.agg(F.sum("target"), F.sum("background")).first()
    scale = F.lit((total[0] or 0) / (total[1] or 1))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    out = None
    for k in range(1, order + 1):
        t = tables[k].withColumn("history", F.expr(f"code div {SYMBOLS}"))
        kinds = lambda c: F.sum((F.col(c) > 0).cast("int"))
        seen = t.groupBy("history").agg(F.sum("target").alias("mt"), F.sum("background").alias("mb"), kinds("target").alias("kt"), kinds("background").alias("kb"))
        t = t.join(seen, "history")
        if out is None:
            t = t.withColumns({"lt": F.lit(1 / SYMBOLS), "lb": F.lit(1 / SYMBOLS)})
        else:
            t = t.withColumn("tail", F.col("code") % SYMBOLS ** (k - 1)).join(out.select(F.col("code").alias("tail"), F.col("pt").alias("lt"), F.col("pb").alias("lb")), "tail")
        pt = F.when(F.col("kt") > 0, (F.col("target") + F.col("kt") * F.col("lt")) / (F.col("mt") + F.col("kt"))).otherwise(F.col("lt"))
        pb = (F.col("background") * scale + F.col("kb") * F.col("lb")) / (F.col("mb") * scale + F.col("kb"))
        out = t.select("code", pt.alias("pt"), pb.alias("pb"))
    return out.select("code", (F.log2("pb") - F.log2("pt")).alias("diff"), (-F.log2("pb")).alias("loss"))


def _block_scores(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Scores of a block's documents; known holds all of its n-grams."""
    total = {"diff": np.zeros(docs.num_rows), "loss": np.zeros(docs.num_rows)}
    raw, off = buffers(docs.column("text"))
    if len(raw):
        codes = known.column("code").to_numpy()
        order = np.argsort(codes)
        codes = codes[order]
        for lo, hi in chunks(off, _CHUNK):
            doc, code = grams(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], _BYTES, SYMBOLS)
            at = order[np.searchsorted(codes, code)]
            for name, sums in total.items():
                sums[lo:hi] = np.bincount(doc, weights=known.column(name).to_numpy()[at], minlength=hi - lo)
    n = np.diff(off)
    diff, loss = (total[k] / np.maximum(n, 1) for k in ("diff", "loss"))
    return pa.table({"rid": docs.column("rid"), "n_tokens": pa.array(n), "ce_diff": pa.array(diff), "target_loss": pa.array(loss + diff), "background_loss": pa.array(loss)})


def cross_entropy_difference(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ce_diff, target_loss, background_loss) per row, in bits a token; `good` holds the ids (column id_col) of the target documents.

    Counts cover every byte of every document, and the tables hold every n-gram that occurs, so what is gathered grows
    with the corpus. Null and empty texts score 0 with 0 tokens; without a target document both models are the
    background; ids in `good` may repeat; repeated rows count and are scored each; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    n = parts_for(rows)
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(4 * n)).cast("long")
    # Texts move once; rows without an id are dealt by their text.
    table = bucketed(rows.withColumn("block", block(F.coalesce(F.col("rid").cast("string"), F.col("text")))), "block", n, "blocks")
    marks = good.select(F.col(id_col).cast(kind).alias("gid")).where(F.col("gid").isNotNull()).distinct().withColumn("block", block(F.col("gid").cast("string")))
    asked = scratch(table.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_block_counts, "block long, code long, target long, background long"), "grams")
    counts = scratch(asked.groupBy("code").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "counts")
    known = asked.select("block", "code").join(differences(counts), "code").select("block", "code", "diff", "loss")
    scored = table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_block_scores, f"rid {kind}, n_tokens long, ce_diff double, target_loss double, background_loss double")
    return scored.withColumnRenamed("rid", id_col)
