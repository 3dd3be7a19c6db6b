"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Texts are cut into units: words with their inner punctuation, and runs of single characters read as one word
("i d i o t"). The gap-weighted subsequence kernel counts common subsequences of ORDER letters, each weighted by
DECAY to the span it covers, so inserted characters and gaps lower a match instead of breaking it. Landmarks are
all units of the training sentences that a significance test finds typical of toxic texts; a unit's kernel row to them (of a unit at least twice as long as the landmark, its best window's), times the inverse root of the landmarks' own kernel
matrix, is its Nyström feature vector. A text is as toxic as its most toxic unit, and the machine is trained that way:
the hinge loss of each labelled text is taken at its highest unit. A logistic scale turns margins into scores; 0.5 is
where the machine decides.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from functools import cache
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, buffers, chunks, kept, ship, trim

ORDER, DECAY = 4, 0.9
#: Shortest unit. Units shorter than ORDER are compared with a kernel of their own length as order.
LEAST = 2
#: Share of landmarks that may be there by chance (false discovery rate).
CHANCE = 0.01
#: Weight in training of all landmarks as texts of their own (labelled texts weigh 1).
ALONE = 0.02
#: Longest landmark; longer units are cut into parts of twice that length, each of which overlaps the next by half.
UNIT = 24
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]\S){2,}(?!\S)")
_RUN = re.compile(r"[^\W_]+")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|/\\*_-~`#$%^&+=…„“”«»¡¿"


def tokens(text: str) -> set[str]:
    """Distinct raw tokens of a text: white-space separated, and spelled-out runs."""
    text = text.lower()
    out = set(text.split())
    if _SPACED.search(text):
        out.update(m.replace(" ", "") for m in _SPACED.findall(text))
    return out


def parts(token: str) -> list[str]:
    """The units that stand for a token: its letters and digits joined, and each run of them between punctuation."""
    t = token.strip(_EDGE)
    runs = [t] if t.isalnum() else _RUN.findall(t)
    out = []
    for u in {"".join(runs), *runs}:
        out += [u] if len(u) <= UNIT else [u[i : i + 2 * UNIT] for i in range(0, len(u) - UNIT // 2, UNIT)]
    return out


def _codes(units: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(units), width), fill, np.int32)
    flat = np.frombuffer("".join(units).encode("utf-32-le"), np.int32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    row = np.repeat(np.arange(len(units)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def kernel(units: np.ndarray, marks: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of units (n x a codes) with marks (m x b, or n x 1 x b for each its own).

    One pass over the units' characters. S[i] holds, for each place of a mark, the weight of all common
    subsequences of length i so far that end at or before that place, decayed to it.
    """
    b = marks.shape[-1]
    marks = marks[None] if marks.ndim == 2 else marks
    shape = (len(units), marks.shape[1], b)
    fall = np.float32(decay) ** np.maximum(np.arange(b)[None, :] - np.arange(b)[:, None], 0)
    fall = np.triu(fall).astype(np.float32)
    s = [np.zeros(shape, np.float32) for _ in range(order - 1)]
    total = np.zeros(shape[:2], np.float32)
    sq = np.float32(decay * decay)
    # One product over all pairs: a stack of small ones costs several times as much.
    for j in range(units.shape[1]):
        match = (units[:, j, None, None] == marks) * sq
        for i in range(order - 1, 0, -1):
            d = match[:, :, 1:] * s[i - 1][:, :, :-1]
            if i == order - 1:
                total += d.sum(axis=2)
            else:
                s[i] *= np.float32(decay)
                s[i][:, :, 1:] += (d.reshape(-1, b - 1) @ fall[1:, 1:]).reshape(d.shape)
        s[0] *= np.float32(decay)
        s[0] += (match.reshape(-1, b) @ fall).reshape(shape)
    return total


@cache
def norm(size: int, order: int = ORDER) -> float:
    """Root of the kernel of a string of distinct letters with itself: the norm given to all strings of that length."""
    word = np.arange(size, dtype=np.int32)[None]
    return float(np.sqrt(kernel(word, word, order)[0, 0]))


class Model:
    """Landmarks, Nyström map, weights and logistic scale; small, and sent to the executors whole."""

    def __init__(self, marks: list[str]):
        self.names = marks
        self.marks = _codes(marks, max(map(len, marks), default=1), -2)
        self.beta, self.bias, self.scale, self.shift = np.zeros(len(marks)), 0.0, 0.0, 0.0
        self.root = np.zeros((0, 0))
        if marks:
            self.letters = np.unique(np.concatenate([m[m >= 0] for m in self.marks]))
            self.bits = np.zeros((len(self.letters) + 1, len(marks)), np.uint32)
            for k, name in enumerate(marks):
                for p, c in enumerate(name):
                    self.bits[np.searchsorted(self.letters, ord(c)), k] |= np.uint32(1 << p)
            self.full = np.array([(1 << len(m)) - 1 for m in marks], np.uint32)
            self.size = np.fromiter(map(len, marks), np.int64, len(marks))
            self.order = np.minimum(self.size, ORDER)
            self.own = np.array([norm(len(m), int(k)) for m, k in zip(marks, self.order, strict=True)], np.float32)
            w = self.rows(marks)
            w = (w + w.T) / 2
            val, vec = np.linalg.eigh(w.astype(np.float64))
            # Directions in which the landmarks hardly differ are left out: their inverse is noise.
            self.root = vec @ np.diag(np.where(val > 1e-3, 1 / np.sqrt(np.maximum(val, 1e-3)), 0)) @ vec.T

    def rows(self, units: list[str]) -> np.ndarray:
        """Normalised kernel rows of units to the landmarks.

        The kernel is zero unless a unit and a landmark have a common subsequence of ORDER letters, or of all letters
        of a shorter landmark; a bit-parallel
        longest-common-subsequence pass finds the pairs that do, and only those are worked out.
        """
        out = np.zeros((len(units), len(self.names)), np.float32)
        if not self.names:
            return out
        size = np.fromiter(map(len, units), np.int64, len(units))
        by_size = np.argsort(size, kind="stable")
        for width in np.unique(size):
            if width < LEAST:
                continue
            pick = by_size[np.searchsorted(size[by_size], width) : np.searchsorted(size[by_size], width, side="right")]
            for lo in range(0, len(pick), 8192):
                at = pick[lo : lo + 8192]
                code = _codes([units[i] for i in at], int(width), -1)
                letter = np.searchsorted(self.letters, code)
                letter[self.letters[np.minimum(letter, len(self.letters) - 1)] != code] = len(self.letters)
                v = np.full((len(at), len(self.names)), 0xFFFFFFFF, np.uint32)
                for j in range(int(width)):
                    m = self.bits[letter[:, j]]
                    u = v & m
                    v = (v + u) | (v - u)
                lcs = np.bitwise_count(~v & self.full)
                i, k = np.nonzero(lcs >= self.order)
                long = 2 * self.size[k] <= width
                self._windows(out, at, code, i[long], k[long])
                i, k = i[~long], k[~long]
                for order in np.unique(self.order[k]):
                    io, ko = (x[self.order[k] == order] for x in (i, k))
                    for a in range(0, len(io), 4096):
                        ia, ka = io[a : a + 4096], ko[a : a + 4096]
                        out[at[ia], ka] = kernel(code[ia], self.marks[ka][:, None, :], int(order))[:, 0] / (np.float32(norm(int(width), int(order))) * self.own[ka])
        return out

    def _windows(self, out: np.ndarray, at: np.ndarray, code: np.ndarray, i: np.ndarray, k: np.ndarray) -> None:
        """Rows of pairs (i, k) whose unit is long: the largest of its windows of the landmark's length and one more."""
        width = code.shape[1]
        for b in np.unique(self.size[k]):
            ib, kb = (x[self.size[k] == b] for x in (i, k))
            order = int(min(b, ORDER))
            for w in (int(b), int(b) + 1):
                each = width - w + 1
                views = np.lib.stride_tricks.sliding_window_view(code, w, axis=1)
                for a in range(0, len(ib), max(1, 4096 // each)):
                    ia, ka = ib[a : a + max(1, 4096 // each)], kb[a : a + max(1, 4096 // each)]
                    got = kernel(views[ia].reshape(-1, w), np.repeat(self.marks[ka][:, :b], each, axis=0)[:, None, :], order).reshape(-1, each).max(axis=1)
                    out[at[ia], ka] = np.maximum(out[at[ia], ka], got / (np.float32(norm(w, order)) * self.own[ka]))

    def margins(self, units: list[str]) -> np.ndarray:
        return self.rows(units) @ self.beta + self.bias

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -60, 60)))


class _Groups:
    """Tells near copies of earlier bags: those that share the two smallest hashes of their longest units, in one of four hashings."""

    def __init__(self):
        self.seen: set = set()

    def is_new(self, bag: set[str]) -> bool:
        long = [u.encode() for u in sorted(bag, key=lambda u: (-len(u), u))[: max(4, len(bag) // 3)]]
        keys = []
        for k in range(4):
            low = sorted(zlib.crc32(u, k * 7919 + 1) for u in long)[:2]
            if len(low) == 2:
                keys.append((k, *low))
        new = not any(x in self.seen for x in keys)
        self.seen.update(keys)
        return new


def typical(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, chance: float = CHANCE) -> list[str]:
    """Units that occur in toxic texts more often than their share of the texts explains, and in more of them than in clean ones.

    One-sided binomial test of each unit, with the step-up bound of Benjamini and Hochberg over the units that occur
    often enough to pass at all; so their number follows the data, and a rare unit isn't measured by a common one.
    """
    q = n_toxic / (n_toxic + n_clean)
    tail: dict[tuple[int, int], float] = {}

    def p(c: int, n: int) -> float:
        if (c, n) not in tail:
            tail[c, n] = sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(q) + (n - k) * log1p(-q)) for k in range(c, n + 1))
        return tail[c, n]

    tests = sum(1 for u in toxic.keys() | clean.keys() if LEAST <= len(u) <= UNIT and q ** (toxic[u] + clean[u]) <= chance)
    found = sorted((p(c, c + clean[u]), u) for u, c in toxic.items() if LEAST <= len(u) <= UNIT and c > clean[u])
    last = max((k for k, (x, _) in enumerate(found, 1) if x <= chance * k / tests), default=0) if tests else 0
    return [u for _, u in found[:last]]


def train(texts: list[str], labels: list[int], rounds: int = 250, penalty: float = 1e-4) -> Model:
    """Fit on labelled texts; equal texts count once, by the mean of their labels."""
    by_text: dict[str, list[int]] = {}
    for t, y in zip(texts, labels, strict=True):
        by_text.setdefault(t, []).append(y)
    y = np.array([1 if 2 * sum(v) >= len(v) else 0 for v in by_text.values()])
    n_pos = int(y.sum())
    if not n_pos or n_pos == len(y):
        model = Model([])
        model.shift = -8.0 if not n_pos else 8.0
        return model
    # Units are kept once and bags as numbers: this runs on the driver, beside Spark's own memory.
    place: dict[str, int] = {}
    bags, new, groups = [], [], _Groups()
    for t in by_text:
        bag = {u for tok in tokens(t) for u in parts(tok) if len(u) >= LEAST}
        new.append(groups.is_new(bag))
        bags.append(np.fromiter((place.setdefault(u, len(place)) for u in bag), np.int64, len(bag)))
    del groups, by_text
    new = np.array(new)
    seen = []
    for label in (0, 1):
        own = [b for b, l, g in zip(bags, y, new, strict=True) if l == label and g]
        seen.append(np.bincount(np.concatenate(own), minlength=len(place)) if own else np.zeros(len(place), np.int64))
    counts = [{u: int(n) for u, n in zip(place, c, strict=True) if n} for c in seen]
    n_neg = len(y) - n_pos
    best = typical(Counter(counts[1]), Counter(counts[0]), int((y[new] == 1).sum()), int((y[new] == 0).sum()))
    del counts, seen
    model = Model(best)
    names = list(place)
    # Units with no common subsequence with any landmark all have the zero vector.
    number = np.zeros(len(names), np.int64)
    phi = [np.zeros((1, max(1, len(best))), np.float32)]
    have = 1
    for lo in range(0, len(names) if best else 0, 16_384):
        rows = model.rows(names[lo : lo + 16_384])
        live = rows.any(axis=1)
        phi.append((rows[live] @ model.root).astype(np.float32))
        number[lo : lo + len(rows)][live] = have + np.arange(int(live.sum()))
        have += int(live.sum())
    phi = np.concatenate(phi) if best else np.zeros((1, 0), np.float32)
    members = [np.unique(np.r_[0, number[b]]) for b in bags]
    # Each landmark is a toxic text of its own too, or one that always comes with others would never be learnt.
    members += [np.array([0, number[place[u]]]) for u in best]
    n_texts, y = len(bags), np.r_[y, np.ones(len(best), int)]
    flat, cut = np.concatenate(members), np.cumsum([0, *map(len, members)])[:-1]
    w, b = np.zeros(len(best)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    owner = np.repeat(np.arange(len(members)), np.diff(np.r_[cut, len(flat)]))
    if best:
        # Start where a landmark's double has margin 1 and a unit half as near -1.
        w = 4 * model.root @ np.ones(len(best))
        b = -3.0
    # A toxic text with nothing near any landmark bears a wrong label as far as this machine can tell.
    told = np.maximum.reduceat((phi @ w)[flat] + b, cut) > 0 if best else y == 1
    weight = np.where(y == 0, 0.5 / n_neg, np.where(told, 0.5 / max(1, int((told & (y == 1))[:n_texts].sum())), 0.0))
    weight[n_texts:] = ALONE / max(1, len(best))
    past = np.full(len(best) + 1, 1e-4)
    for _ in range(rounds):
        f = (phi @ w)[flat] + b
        top = np.maximum.reduceat(f, cut)
        hit = np.flatnonzero(f == top[owner])
        witness = np.zeros(len(members), np.int64)
        witness[owner[hit[::-1]]] = flat[hit[::-1]]
        bad = sign * top < 1
        g = np.append((weight * sign * bad) @ phi[witness], (weight * sign * bad).sum())
        past += g * g
        move = 0.5 * g / np.sqrt(past)
        w, b = w * (1 - penalty) + move[:-1], b + move[-1]
    top, y = np.maximum.reduceat((phi @ w)[flat] + b, cut)[:n_texts], y[:n_texts]
    # Logistic fit of the scale of the margins, by damped Newton steps; a margin of 0, where the machine decides, is 0.5.
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(top * a, -30, 30)))
        a += (top @ (y - p) - 1e-3 * a) / ((top * top) @ (p * (1 - p)) + 1e-3)
    model.beta, model.bias = (model.root @ w if best else w), b
    model.scale = max(float(a), 1e-6)
    del phi, flat, owner, members, place, names
    trim()
    return model


class Scorer:
    """Scores texts; margins of tokens are kept, in two generations of bounded size."""

    MOST = 150_000

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def learn(self, words: set[str]) -> None:
        young, old = self.young, self.old
        new = words.difference(young)
        if len(young) + len(new) > self.MOST:
            self.old = old = young
            self.young = young = {}
            new = words
        known = [w for w in new if w in old]
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        fresh = list(new.difference(old))
        pieces = [parts(w) for w in fresh]
        flat = [p for ps in pieces for p in ps]
        margin = self.model.margins(flat)
        at = np.cumsum([0, *map(len, pieces)])[:-1]
        if len(flat):
            young.update(zip(fresh, np.maximum.reduceat(margin, at).tolist(), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        self.learn(set().union(*bags))
        floor = self.model.bias
        get = self.young.__getitem__
        return self.model.score(np.array([max(map(get, bag), default=floor) for bag in bags]))


def _score(batches, model, key):
    scorer = kept(key, lambda: Scorer(model.value))
    for batch in batches:
        col = batch.column("text")
        out = []
        for lo, hi in chunks(buffers(col)[1], 2 * CHUNK_BYTES):
            out.append(scorer.scores([t or "" for t in col[lo:hi].to_pylist()]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.concatenate(out) if out else [], pa.float64())], [*(c for c in batch.schema.names if c != "text"), "score"])


def labelled(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most `most` labelled training texts (a fixed pseudo-random choice), outside the held-out fifth."""
    kept = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out("k"))
    kept = kept.orderBy(F.xxhash64("k"), "k", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(kept), "k").select("text", "y").collect()
    rows.sort()
    return [r[0] for r in rows], [r[1] for r in rows]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, in one pass without a shuffle.

    Null and empty texts get the score of a text without any unit; texts of any length are read whole; repeated rows
    are each scored; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    key = ("toxicity", uuid.uuid4().hex)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _score(it, sent, key), f"rid {kind}, score double").withColumnRenamed("rid", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted (the contract of op2)."""
    model = train(*labelled(docs, labels, most))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _reject(batches, model, key):
    scorer = kept(key, lambda: Scorer(model.value))
    for batch in batches:
        col = batch.column("text")
        keep = [scorer.scores([t or "" for t in col[lo:hi].to_pylist()]) < 0.5 for lo, hi in chunks(buffers(col)[1], 2 * CHUNK_BYTES)]
        yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the rows whose score is below 0.5. docs has a column `text`."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    key = ("toxicity", uuid.uuid4().hex)
    return docs.mapInArrow(lambda it: _reject(it, sent, key), docs.schema)
