"""Exact token counts at every prefix, by a dynamic programme over the last token of each prefix."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship

#: Pieces of the byte-level tokenizer: its splitting pattern, stated as in its library.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same over Latin-1 (letters, digits and white space spelt out), for a faster library.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PIECES_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
SPECIAL = "<|endoftext|>"
_WHITE = regex.compile(r"\s+")
# The contractions of two letters that the splitting pattern takes as pieces.
_TWO_LETTERS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Token counts of a byte-pair vocabulary; as a dict it keeps the table of each piece: the count at every prefix.

    For each byte position of a piece the programme finds the last token of that prefix's encoding and
    the number of tokens; the piece's table keeps the counts at its character edges. The last token is the only vocabulary entry t ending there for which t may
    follow the last token of what precedes it; whether two tokens may stand side by side is read off the
    merges that made them. So every prefix of a piece has its count without encoding it again.
    """

    #: Pieces in each of two generations; those used again move from the old to the young one.
    MOST = 400_000

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, bytes | tuple] = {}
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.tokens = {spell(t): i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.tokens))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {}
        self.parts = {}
        for r, (a, b) in enumerate(merges):
            x, y = self.tokens[spell(a)], self.tokens[spell(b)]
            self.rank[x, y] = r
            self.parts.setdefault(self.tokens[spell(a) + spell(b)], (r, x, y))
        self.follows: dict = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these two tokens.

        Undo the merges along the seam, the latest first: the pair stands unless the two tokens that
        meet at the seam at some moment have a merge that comes before the next one undone.
        """
        key = left << 20 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 600_000:
                self.follows.clear()
            known = self.follows[key] = self._may_follow(left, right)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        never = (len(self.rank) + 1, 0, 0)
        parts, rank, bound = self.parts, self.rank, never[0]
        while True:
            r = rank.get((a, b))
            if r is not None and r < bound:
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            # Undo the later of the two merges; of equal ones the right one came later.
            if pb is None or pa_ is not None and pa_[0] > pb[0]:
                bound, a = pa_[0], pa_[2]
            else:
                bound, b = pb[0] + 1, pb[1]

    def prefixes(self, piece: bytes) -> list[int]:
        """Number of tokens of piece[:i] for i = 0 ... len(piece)."""
        get, known, may, longest = self.tokens.get, self.follows.get, self.may_follow, self.longest
        last, count = [-1], [0]
        for end in range(1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                t = get(piece[start:end])
                if t is not None:
                    fits = True if not start else known(last[start] << 20 | t)
                    if fits or fits is None and may(last[start], t):
                        last.append(t)
                        count.append(count[start] + 1)
                        break
        return count

    def __missing__(self, piece: str) -> bytes | tuple:
        t = self.old.get(piece)
        if t is None:
            t = self.prefixes(piece.encode())
            if not piece.isascii():
                edges = np.cumsum([0, *(len(c.encode()) for c in piece)]).tolist()
                t = [t[e] for e in edges]
            if piece in _TWO_LETTERS:
                t[2] = t[1] + self[piece[1]][-1]  # cut there, it is no contraction
            t = bytes(t) if max(t) < 256 else tuple(t)
        if len(self) >= self.MOST:
            self.old = dict(self)
            self.clear()
        self[piece] = t
        return t

    @staticmethod
    def pattern(text: str):
        return PIECES_LATIN if text.isascii() or max(text) < "\u0100" else PIECES

    def split(self, text: str) -> list[str]:
        return self.pattern(text).findall(text)

    def count(self, text: str) -> int:
        """Tokens of the text: the last entries of its pieces' tables."""
        if SPECIAL not in text:
            return sum([t[-1] for t in map(self.__getitem__, self.split(text))])
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(map(self.count, parts))

    def table(self, text: str) -> list[int]:
        """Tokens of text[:i], as the tokenizer counts them, for i = 0 ... the number of characters.

        A prefix is split into the pieces before it and the beginning of its last piece, whose table has the count.
        Two prefixes are split otherwise: one that ends within a special string, and one that ends with a run of
        white space, whose last character belongs to the next word only if that word is there.
        """
        out, total, parts, before, last = [0], 0, text.split(SPECIAL), 0, ""
        for k, part in enumerate(parts):
            if k:
                # The text that a part of the special string may join: the last piece before it.
                out += [before + self.count(last + SPECIAL[:j]) for j in range(1, len(SPECIAL))]
                total += 1
                out.append(total)
                before, last = total, ""
            for piece in self.split(part):
                own = self[piece]
                at = len(out)
                out += [total + c for c in own[1:]]
                if last and _WHITE.match(piece) and _WHITE.fullmatch(last):
                    out[at] = before + self[last + piece[0]][-1]
                before, last = total, piece
                total += own[-1]
        return out

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens (counts may fall as a prefix grows).

        Only the pieces through which the budget lasts are looked at: after a piece before which `budget` tokens stand,
        and the white space that may follow, every prefix has more.
        """
        if SPECIAL in text:
            return int(max(np.flatnonzero(np.array(self.table(text)) <= budget), default=0))
        best = at = total = before = 0
        last = ""
        for m in self.pattern(text).finditer(text):
            if before >= budget:
                break
            piece = m[0]
            own = self[piece]
            if total + own[-1] <= budget:
                best = at + len(piece)
            else:
                best = max([best, *(at + i for i in range(1, len(own)) if total + own[i] <= budget)])
            if last and _WHITE.match(piece) and _WHITE.fullmatch(last):
                run = before + self[last + piece[0]][-1]
                if run <= budget:
                    best = max(best, at + 1)
                elif best == at + 1:
                    best = at if total <= budget else self.within(text[:at], budget)
            at += len(piece)
            before, last = total, piece
            total += own[-1]
        return best


def counter(path: str) -> PrefixCounter:
    return kept(("prefixes", path), lambda: PrefixCounter(path))


def _count(batches, path, with_table, budget):
    c = counter(path)
    for batch in batches:
        n, size, tables, chars, heads = [], [], [], [], []
        for t in batch.column("text"):
            t = t.as_py() or ""
            n.append(c.count(t))
            size.append(len(t) if t.isascii() else len(t.encode()))
            if with_table:
                tables.append(c.table(t))
            if budget is not None:
                chars.append(len(t) if n[-1] <= budget else c.within(t, budget))
                heads.append(size[-1] if chars[-1] == len(t) else len(t[: chars[-1]].encode()))
        cols = [batch.column("rid"), pa.array(size, pa.int64()), pa.array(n, pa.int64())]
        names = ["rid", "n_bytes", "n_tokens"]
        if with_table:
            cols.append(pa.array(tables, pa.list_(pa.int32())))
            names.append("prefix_tokens")
        if budget is not None:
            cols += [pa.array(chars, pa.int64()), pa.array(heads, pa.int64())]
            names += ["chars_within", "bytes_within"]
        yield pa.RecordBatch.from_arrays(cols, names)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_table: bool = False, budget: int | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_tokens; with_table prefix_tokens, the count at every prefix (by characters, from 0);
    with a budget chars_within and bytes_within, the size of the longest prefix of at most that many tokens.

    One pass without a shuffle. Null text counts as empty (0 bytes, 0 tokens); texts are never cut; ties
    and repeated rows are each counted; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    schema = f"rid {kind}, n_bytes long, n_tokens long" + (", prefix_tokens array<int>" if with_table else "") + (", chars_within long, bytes_within long" if budget is not None else "")
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _count(it, tokenizer_path, with_table, budget), schema).withColumnRenamed("rid", id_col)


def chars_within(prefix_tokens, budget: int):
    """Column: characters of the longest prefix of at most `budget` tokens, read off a stored table without encoding again."""
    return F.expr(f"array_max(transform({prefix_tokens}, (c, i) -> IF(c <= {int(budget)}, i, 0)))")
