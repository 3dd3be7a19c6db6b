"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page.

A page is read into leaf blocks with the tags, classes and ids above them. Each block becomes a vector of hashed path
names, hashed words and a few measures; the network reads a page's blocks in both directions, so each decision sees
the whole page. It is trained at first use, on a bounded sample of the pages labelled by their semantic mark-up and on
pages composed from layouts below (menus, notices, adverts, forms, comments ...), with names dropped at random.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, kept, ship, words_of

PATH, WORDS, HIDDEN = 96, 32, 20
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
# Elements whose content is no text of the page.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "textarea")
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
#: Outermost and innermost elements whose names make a block's path (deeper nesting is no layout).
DEPTH = 64
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARS = ("article", "main", "table")
#: Names that mark what is not the article; the teacher's rule and the composed pages use them.
BOILER = frozenset("nav header footer aside form menu navbar navigation sidebar ad ads advert advertisement banner sponsor promo cookie notice consent alert newsletter subscribe signup login search comments comment respond reply replies related share social breadcrumb pagination pager widget toolbar copyright head title button select option dialog popup modal".split())
MAIN = frozenset("article main".split())


def _tags(page: str):
    """(start, end, name of an opening tag, its attributes, name of a closing tag) of all mark-up, in linear time.

    A tag ends at the first > outside quotes. If a quote is never closed, quotes no longer count in the rest of the
    page; a < that begins no tag is text, and so is all after the last >.
    """
    strict, at, last = True, 0, page.rfind(">")
    while True:
        a = page.find("<", at)
        if a > last:
            a = page.find("<!--", a)
        if a < 0:
            return
        at = a + 1
        c = page[at : at + 1]
        if c == "!" or c == "?":
            b = page.find("-->", a + 4) + 2 if page.startswith("<!--", a) else page.find(">", at)
            if b == 1:
                b = len(page) - 1
            yield a, b + 1, None, "", None
            at = b + 1
            continue
        close = c == "/"
        m = _NAME.match(page, at + close)
        if not m:
            continue
        b = m.end()
        if close:
            b = page.find(">", b)
        elif strict:
            while True:
                stop = _STOP.search(page, b)
                b = stop.start() if stop else -1
                if b < 0 or page[b] == ">":
                    break
                b = page.find(page[b], b + 1) + 1
                if not b:
                    b = -1
                    break
            if b < 0:
                strict = False
        if not close and not strict:
            b = page.find(">", m.end())
        name = m[0].lower()
        at = b + 1
        if close:
            yield a, at, None, "", name
        elif name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            yield a, at, None, "", None
        else:
            yield a, at, name, page[m.end() : b], None


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path names, share of linked characters) of each block with text, in page order, in linear time."""
    out = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}
    text: list[str] = []
    linked = total = 0
    in_link = 0

    def flush():
        nonlocal linked, total
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                path = stack if len(stack) <= 2 * DEPTH else stack[:DEPTH] + stack[-DEPTH:]
                out.append((words, tuple(n for _, names in path for n in names), linked / max(1, total)))
            text.clear()
        linked = total = 0

    def pop():
        places[stack.pop()[0]].pop()

    def close(name):
        nonlocal in_link
        if name == "a":
            in_link = max(0, in_link - 1)
            return
        if name in INLINE:
            return
        flush()
        k = places[name][-1] if places.get(name) else -1
        # A closing tag doesn't reach out of the article or table that it stands in.
        bar = -1 if name in BARS or name in ("html", "div", "section") else max((places[n][-1] for n in (*BARS, "body") if places.get(n)), default=-1)
        if k > bar or k >= 0 and name in BARS:
            while len(stack) > k:
                pop()
            in_link = 0

    at = 0
    for a, b, name, attributes, closing in _tags(page):
        if a > at:
            piece = page[at:a]
            text.append(piece)
            total += len(piece)
            if in_link:
                linked += len(piece)
        at = b
        if name:
            if name == "a":
                in_link += 1
            if name in INLINE:
                if name == "br":
                    text.append(" ")
                continue
            flush()
            in_link = 0
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                pop()
            elif name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and (stack[-1][0] == name or name in ("dt", "dd") and stack[-1][0] in ("dt", "dd")):
                pop()
            if name not in VOID and not attributes.endswith("/"):
                names = [name]
                low = attributes.lower()
                if "class" in low or "id" in low or "role" in low:
                    for g in _NAMES.findall(attributes):
                        names += [x for x in _SPLIT.split("".join(g).lower()) if x]
                places.setdefault(name, []).append(len(stack))
                stack.append((name, tuple(names)))
        elif closing:
            close(closing)
    if at < len(page):
        text.append(page[at:])
        total += len(page) - at
    flush()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH


def features(pages: list[list[tuple[str, tuple[str, ...], float]]], cache: dict, drop: np.random.Generator | None = None) -> np.ndarray:
    """Vectors of all blocks of the pages, in order."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), PATH + WORDS + 6), np.float32)
    for i, (_, path, _) in enumerate(flat):
        v = cache.get(path)
        if v is None:
            v = np.zeros(PATH, np.float32)
            names = path if drop is None else [n for n in path if drop.random() > 0.15]
            for n in names:
                v[_slot(n)] = 1
            if names:
                v[_slot("last " + names[-1])] += 1
            if drop is None and len(cache) < 100_000:
                cache[path] = v
        x[i, :PATH] = v
    raw, off = buffers(pa.array([b[0] for b in flat], pa.string()))
    n = np.zeros(len(flat))
    for lo, hi in chunks(off):
        _, _, _, doc, h = words_of(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        count = np.bincount(doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=(hi - lo) * WORDS).reshape(-1, WORDS)
        n[lo:hi] = count.sum(axis=1)
        x[lo:hi, PATH : PATH + WORDS] = np.sqrt(count / np.maximum(1, n[lo:hi, None]))
    size = np.diff(off)
    sizes = [len(p) for p in pages]
    place = np.concatenate([np.arange(k) / max(1, k - 1) for k in sizes]) if sizes else np.zeros(0)
    x[:, -6] = np.log1p(n) / 4
    x[:, -5] = np.log1p(size) / 6
    x[:, -4] = [b[2] for b in flat]
    x[:, -3] = place
    x[:, -2] = np.minimum(1, n / 12)
    x[:, -1] = 1
    return x


def _sig(x):
    return 1 / (1 + np.exp(-x))


class BiLSTM:
    """Two LSTM layers, one in each direction, and a logistic output for each block."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 5):
        g = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = g.normal(0, size**-0.5, (size, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = g.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        self.p["o"] = g.normal(0, hidden**-0.5, 2 * hidden).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of x (pages x blocks x size); mask is 0 at padding, which leaves the state alone."""
        n, t, _ = x.shape
        both, tape = [], {}
        for d in "fb":
            z = x @ self.p["x" + d] + self.p["c" + d]
            h = c = np.zeros((n, self.h), np.float32)
            out, steps = np.zeros((n, t, self.h), np.float32), []
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                a = z[:, k] + h @ self.p["h" + d]
                i, f, o = (_sig(a[:, j * self.h : (j + 1) * self.h]) for j in range(3))
                u = np.tanh(a[:, 3 * self.h :])
                m = mask[:, k, None]
                new = f * c + i * u
                tc = np.tanh(new)
                if keep:
                    steps.append((k, h, c, i, f, o, u, tc, m))
                c = m * new + (1 - m) * c
                h = m * (o * tc) + (1 - m) * h
                out[:, k] = h
            both.append(out)
            tape[d] = steps
        both = np.concatenate(both, axis=2)
        logit = both @ self.p["o"] + self.p["ob"]
        return (logit, both, tape) if keep else logit

    def gradients(self, x, mask, y):
        logit, both, tape = self.run(x, mask, True)
        d_logit = ((_sig(logit) - y) * mask / mask.sum()).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", d_logit, both), "ob": d_logit.sum(keepdims=True).reshape(1)}
        for j, d in enumerate("fb"):
            d_out = d_logit[:, :, None] * self.p["o"][j * self.h : (j + 1) * self.h]
            dz = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            dh = dc = np.zeros((len(x), self.h), np.float32)
            for k, h, c, i, f, o, u, tc, m in reversed(tape[d]):
                dh = dh + d_out[:, k]
                dn = m * dh
                dcc = m * dc + dn * o * (1 - tc * tc)
                da = np.concatenate([dcc * u * i * (1 - i), dcc * c * f * (1 - f), dn * tc * o * (1 - o), dcc * i * (1 - u * u)], axis=1)
                dz[:, k] = da
                gh += h.T @ da
                dc = (1 - m) * dc + dcc * f
                dh = (1 - m) * dh + da @ self.p["h" + d].T
            g["h" + d], g["c" + d] = gh, dz.sum((0, 1))
            g["x" + d] = np.tensordot(x, dz, ((0, 1), (0, 1)))
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 18, batch: int = 32, rate: float = 0.01, seed: int = 6):
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                x, mask = padded([pages[i] for i in pick])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(pick):
                    y[r, : len(labels[i])] = labels[i]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    now = rate * (1 - epoch / epochs)
                    self.p[k] = (self.p[k] - now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((len(pages), t, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), t), np.float32)
    for r, p in enumerate(pages):
        x[r, : len(p)] = p
        mask[r, : len(p)] = 1
    return x, mask


def taught(path: tuple[str, ...]) -> int:
    """The teacher's label by semantic mark-up: inside an article or main element, and nothing else on the way."""
    return int(any(n in MAIN for n in path) and not any(n in BOILER for n in path))


def composed(texts: list[str], rng: np.random.Generator, n: int) -> list[tuple[list, list[int]]]:
    """Pages put together from layouts, with texts of the sample: (blocks, labels)."""
    def some(lo, hi):
        words = texts[rng.integers(len(texts))].split()
        k = int(rng.integers(lo, hi))
        at = int(rng.integers(max(1, len(words) - k)))
        return " ".join(words[at : at + k]) or "text"

    def one(*options):
        return options[rng.integers(len(options))]

    out = []
    for _ in range(n):
        blocks: list = []
        bare = rng.random() < 0.05
        root = () if bare else ("html", "body") + one((), ("div", "wrapper"), ("div", "page", "container"), ("div",))

        def add(path, label, lo, hi, link=0.0, root=root, blocks=blocks):
            blocks.append(((some(lo, hi), root + path, link), label))

        def boiler(where):
            kind = one("nav", "header", "ad", "notice", "form", "aside", "related", "share", "comments", "footer") if where == "any" else where
            if kind == "nav":
                for _ in range(int(rng.integers(3, 9))):
                    add(one(("nav", "ul", "li"), ("div", "menu", "ul", "li"), ("ul", "navbar", "li"), ("div", "navigation", "ul", "li")), 0, 1, 3, 1.0)
            elif kind == "header":
                add(one(("header",), ("header", "div"), ("div", "header"), ("header", "h1"), ("header", "p")), 0, 1, 8)
            elif kind == "ad":
                add(one(("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "ad"), ("div", "banner"), ("section", "promo"), ("div", "sponsor"), ("div", "ad", "p")), 0, 3, 40, float(rng.random() < 0.3))
            elif kind == "notice":
                add(one(("div", "cookie", "banner"), ("div", "notice"), ("div", "cookie", "notice", "p"), ("div", "consent"), ("div", "alert"), ("section", "notice", "p")), 0, 3, 30)
            elif kind == "form":
                for _ in range(int(rng.integers(1, 4))):
                    add(one(("form",), ("form", "p"), ("form", "search"), ("div", "newsletter", "form"), ("form", "div"), ("form", "button")), 0, 1, 8)
            elif kind == "aside":
                for _ in range(int(rng.integers(1, 6))):
                    add(one(("aside", "p"), ("aside", "ul", "li"), ("div", "sidebar", "p"), ("div", "sidebar", "ul", "li"), ("aside", "h3"), ("aside", "div", "widget")), 0, 2, 30, float(rng.random() < 0.6))
            elif kind == "related":
                for _ in range(int(rng.integers(2, 6))):
                    add(one(("div", "related", "ul", "li"), ("section", "related", "li"), ("div", "related", "p")), 0, 2, 9, 1.0)
            elif kind == "share":
                add(one(("div", "share"), ("div", "social", "ul", "li"), ("div", "breadcrumb"), ("div", "pagination")), 0, 1, 6, 1.0)
            elif kind == "comments":
                for _ in range(int(rng.integers(1, 7))):
                    add(one(("section", "comments", "div", "comment", "p"), ("div", "comments", "p"), ("section", "comments", "ul", "li"), ("div", "comments", "div", "comment"), ("ol", "comments", "li", "comment", "p"), ("section", "comments", "article", "comment", "p")), 0, 3, 60)
            else:
                for _ in range(int(rng.integers(1, 3))):
                    add(one(("footer",), ("footer", "p"), ("div", "footer"), ("footer", "ul", "li"), ("footer", "div", "copyright")), 0, 2, 12, float(rng.random() < 0.3))

        for kind in ("header", "nav", "notice", "ad"):
            if not bare and rng.random() < 0.6:
                boiler(kind)
        base = () if bare else one(("article",), ("main",), ("main", "article"), ("article", "post"), ("div", "content"), ("div", "article", "body"), ("div", "post", "content"), ("main", "div", "content"), ("div", "entry", "content"), ("section", "story"), ("div", "main"), (), ())
        if rng.random() < 0.8:
            add((*base, one("h1", "h2")), 1, 2, 14)
        for _ in range(int(rng.integers(1, 14))):
            add((*base, one("p", "p", "p", "p", "p", "blockquote", "h2", "h3", "pre", "td", "div")), 1, 1, 90)
            if rng.random() < 0.15:
                for _ in range(int(rng.integers(1, 6))):
                    add((*base, one("ul", "ol"), "li"), 1, 1, 12)
            if rng.random() < 0.08:
                inside = one(("div", "ad"), ("aside",), ("div", "share"), ("form",), ("div", "newsletter"), ("div", "related"), ("div", "comments", "p"), ("footer",))
                add((*base, *inside), 0, 2, 25)
        for _ in range(0 if bare else int(rng.integers(0, 4))):
            boiler("any")
        if not bare and rng.random() < 0.8:
            boiler("footer")
        # The title and what stands outside any layout.
        if rng.random() < (0.3 if bare else 0.9):
            blocks.insert(0, ((some(2, 10), ("html", "head", "title"), 0.0), 0))
        out.append(([b for b, _ in blocks], [y for _, y in blocks]))
    return out


def train(pages: list[str], made: int = 900, seed: int = 7) -> BiLSTM:
    """Fit on sampled pages and on composed ones."""
    rng = np.random.default_rng(seed)
    read = [b for b in map(leaf_blocks, pages) if b]
    texts = [t for p in read for t, _, _ in p if len(t) > 40] or ["word " * 60]
    # Only pages with semantic mark-up can be labelled by it.
    known = [(p, [taught(path) for _, path, _ in p]) for p in read]
    known = [(p, y) for p, y in known if any(y)]
    data = known + composed(texts, rng, made)
    x = features([p for p, _ in data], {}, rng)
    cut = np.cumsum([len(p) for p, _ in data])[:-1]
    net = BiLSTM(x.shape[1])
    net.fit(np.split(x, cut), [np.array(y, np.float32) for _, y in data])
    return net


def extract(pages: list[str], net: BiLSTM, cache: dict) -> list[list[str]]:
    """The blocks of each page that the network takes for the article's."""
    read = [leaf_blocks(p) for p in pages]
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    out: list[list[str]] = [[] for _ in read]
    lo = 0
    while lo < len(order):
        hi = lo
        while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(read[order[hi]]) <= 20_000 or hi == lo:
            hi += 1
        pick = order[lo:hi]
        x = features([read[i] for i in pick], cache)
        cut = np.cumsum([len(read[i]) for i in pick])[:-1]
        px, mask = padded(np.split(x, cut))
        logit = net.run(px, mask)
        for r, i in enumerate(pick):
            out[i] = [b[0] for b, v in zip(read[i], logit[r], strict=False) if v > 0]
        lo = hi
    return out


def _extract(batches, net):
    cache = kept("paths", dict)
    for batch in batches:
        col = batch.column("html")
        texts = []
        for lo, hi in chunks(buffers(col)[1], 4 << 20):
            texts += [" ".join(b) for b in extract([p or "" for p in col[lo:hi].to_pylist()], net.value, cache)]
        yield pa.RecordBatch.from_arrays([batch.column("pid"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["pid", "url", "text", "n_chars"])


def main_text(pages: DataFrame, sample: int = 120, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per page: the article's blocks joined by one space, white space in blocks folded.

    The network is trained on at most `sample` pages (a fixed pseudo-random choice by id) and on composed ones; every
    page is then read whole, in one pass without a shuffle. Null or empty html gives an empty text; pages without
    any block likewise; repeated rows are each read; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    keys = pages.select(F.col(id_col).alias("pid")).where(F.col("pid").isNotNull()).distinct().orderBy(F.xxhash64("pid"), "pid").limit(sample)
    got = pages.select(F.col(id_col).alias("pid"), F.col(html_col).alias("html")).where(F.col("html").isNotNull()).join(F.broadcast(keys), "pid").orderBy(F.xxhash64("pid"), "html").limit(sample).collect()
    net = spark.sparkContext.broadcast(train([r[1] for r in got]))
    rows = pages.select(F.col(id_col).alias("pid"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind, url = rows.dtypes[0][1], rows.dtypes[1][1]
    return rows.mapInArrow(lambda it: _extract(it, net), f"pid {kind}, url {url}, text string, n_chars long").withColumnRenamed("pid", id_col)
