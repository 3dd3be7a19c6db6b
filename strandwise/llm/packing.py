"""Packing by minimum bin slack: a bitset subset-sum programme fills each window of tokens."""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, buffers, chunks, kept, ship

#: Words of the word tokenizer: its splitting pattern, stated as in its file.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same over Latin-1 (letters, digits and white space spelt out), for a faster library.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
WORDS_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")


def spell(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    return np.array(ids, "<u4").tobytes()


class WordIds(dict):
    """Word to its ids as little-endian 32-bit bytes.

    Words are encoded once and kept in two generations of bounded size: when the young one is full it
    becomes the old one, and words used again move back.
    """

    MOST = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = {t: spell([self.tok.token_to_id(t)]) for t in ("<|startoftext|>", "<|endoftext|>")}

    def __missing__(self, word: str) -> bytes:
        self.learn({word})
        return self[word]

    def learn(self, words: set[str]) -> None:
        """Make sure that all these words are known, with one call of the tokenizer for the new ones."""
        new = words.difference(self)
        if len(self) + len(new) > self.MOST:
            self.old = dict(self)
            self.clear()
            new = words
        if self.old:
            old = self.old
            known = [w for w in new if w in old]
            self.update(zip(known, map(old.__getitem__, known), strict=True))
            new = new.difference(old)
        rare = [w for w in new if not is_latin(w)]
        for w, e in zip(rare, self.tok.encode_batch_fast(rare, add_special_tokens=False), strict=True):
            self[w] = spell(e.ids)
        new = list(new.difference(rare))
        for lo in range(0, len(new), 4096):
            # White space separates words and leaves no id; the last token of each word bears the end mark.
            part = new[lo : lo + 4096]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            data, cut = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            self.update(zip(part, [data[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def split(self, text: str) -> list[str]:
        """Words of a text, with the special tokens' strings as words of their own."""
        if "<|" in text and SPECIAL.search(text):
            out, at = [], 0
            for m in SPECIAL.finditer(text):
                out += [*self.split(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self.split(text[at:])
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if is_latin(text):
            return WORDS_LATIN.findall(text.lower())
        return WORDS.findall(lower(text))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words) - self.special.keys())
        self.update(self.special)
        return [b"".join(map(self.__getitem__, w)) for w in words]


def is_latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0100"


def lower(text: str) -> str:
    """Lower case character by character, as the tokenizer does (no final-sigma rule)."""
    return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)


def fill(lengths: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Multiset of lengths (length, count) whose sum comes closest to capacity from below.

    Bit s of the programme's state is set if sum s can be reached. A length with count c enters as
    pieces of 1, 2, 4 ... copies; states are kept and walked back for the counts. Longer lengths come
    first, so they are preferred when several multisets are equally close.
    """
    mask = (1 << (capacity + 1)) - 1
    steps, state = [], 1
    for length in sorted(lengths, reverse=True):
        left, part = min(lengths[length], capacity // length), 1
        while left > 0:
            part = min(part, left)
            new = (state | state << length * part) & mask
            if new != state:
                steps.append((state, length, part))
                state = new
            left -= part
            part *= 2
        if state >> capacity & 1:
            break
    at, counts = state.bit_length() - 1, defaultdict(int)
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            counts[length] += part
    return list(counts.items())


def pack_rows(rows, capacity: int, pool: int, block: int):
    """Pieces (row number, start, length, ids crc32, document tokens, sequence, offset) of one task's rows.

    rows yields (key, ids as bytes). Whole windows are cut off each document first; remainders wait in a
    pool of bounded size until a multiset of them fills a window closest to capacity. A window that
    stays short is closed with the head of a waiting piece, so it has no slack. What is left at the end is cut
    to powers of two, which need no padding.
    """
    waiting: dict[int, list] = defaultdict(list)
    counts: dict[int, int] = {}
    held = 0
    seq = block << 32

    def piece(key, start, ids, total, at):
        return key, start, len(ids) // 4, zlib.crc32(ids), total, seq, at

    def take(length):
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return waiting[length].pop()

    def put(item):
        n = len(item[2]) // 4
        waiting[n].append(item)
        counts[n] = counts.get(n, 0) + 1

    def close(chosen, cut):
        nonlocal seq, held
        at, out = 0, []
        for length, times in chosen:
            for _ in range(times):
                key, start, ids, total = take(length)
                held -= 1
                out.append(piece(key, start, ids, total, at))
                at += length
        if at < capacity and cut and counts:
            key, start, ids, total = take(max(counts))  # every single piece left is longer than the slack
            room = capacity - at
            out.append(piece(key, start, ids[: 4 * room], total, at))
            put((key, start + room, ids[4 * room :], total))
        seq += 1
        return out

    for key, ids in rows:
        total, start = len(ids) // 4, 0
        while total - start >= capacity:
            yield piece(key, start, ids[4 * start : 4 * (start + capacity)], total, 0)
            seq += 1
            start += capacity
        if start < total:
            put((key, start, ids[4 * start :], total))
            held += 1
        while held >= pool:
            yield from close(fill(counts, capacity), True)
    while sum(n * c for n, c in counts.items()) >= capacity:
        yield from close(fill(counts, capacity), True)
    left = sum(n * c for n, c in counts.items())
    rest = [x for n in sorted(waiting, reverse=True) for x in waiting[n]]
    size, at = (1 << left.bit_length()) >> 1, 0
    for key, start, ids, total in rest:
        while ids:
            part = ids[: 4 * (size - at)]
            yield piece(key, start, part, total, at)
            n = len(part) // 4
            start, ids, at, left = start + n, ids[4 * n :], at + n, left - n
            if at == size:
                seq, at = seq + 1, 0
                size = (1 << left.bit_length()) >> 1
    return


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(batches, path, end_id, capacity, pool):
    words = kept(("words", path), lambda: WordIds(path))
    end = spell([end_id])
    kind = None

    def rows():
        nonlocal kind
        for batch in batches:
            kind = batch.column("doc_id").type
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in chunks(buffers(texts)[1], 4 * CHUNK_BYTES):
                for key, ids in zip(keys[lo:hi], words.ids([t or "" for t in texts[lo:hi].to_pylist()]), strict=True):
                    yield key, ids + end

    out = []
    for x in pack_rows(rows(), capacity, pool, TaskContext.get().partitionId()):
        out.append(x)
        if len(out) == 10_000:
            yield _batch(out, kind)
            out = []
    if out:
        yield _batch(out, kind)


def _batch(out, kind):
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], _OUT)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, pool: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows into sequences of at most `capacity` tokens; one output row per piece.

    Each task packs the rows it reads, in one pass without a shuffle, holding at most `pool` remainders.
    sequence_id is the task's number times 2**32 plus a counter. Null or empty text is the end token
    alone; very long texts are cut into as many windows as they fill; repeated rows are each packed;
    other columns are ignored; an empty table gives no rows; ids of any type keep it, and null ids stay null.
    """
    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _OUT[1:])
    return rows.mapInArrow(lambda it: _pack(it, tokenizer_path, end_id, capacity, pool), schema)
