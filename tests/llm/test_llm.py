"""Operators for training text against brute force, round trips and held-out cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandwise.llm import common, decontaminate, html_text, lm_scoring, near_dedup, packing, sharding, suffix_dedup, token_counts, toxicity, webp
from strandwise.llm.common import buffers

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "é" * 7, "a" * 500, "word " * 2000, "same text here for all of you", "same text here for all of you", "  ½² ǅ Σς İ <|endoftext|> x", "!!! ???"]
BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").toPandas()
    more = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(ODD)), "text": ODD, "source": [None, "x"] * (len(ODD) // 2)})
    return pd.concat([d, more], ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, docs):
    # A column whose name the operators also use.
    rows = [(int(a), b, c, 0) for a, b, c in zip(docs.doc_id, docs.text, docs.source.where(docs.source.notna(), None), strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_bytes int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert token_counts.token_counts(empty, BYTE).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert sharding.stratified_shards(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert webp.media_columns(empty).count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert lm_scoring.cross_entropy_difference(empty, labels).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_counts(frame, docs):
    t = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in token_counts.token_counts(frame, BYTE, with_table=True).collect()}
    for i, s in zip(docs.doc_id, docs.text, strict=True):
        s = s or ""
        assert (got[i].n_bytes, got[i].n_tokens) == (len(s.encode()), len(t.encode(s, add_special_tokens=False).ids))
        assert len(got[i].prefix_tokens) == len(s) + 1 and got[i].prefix_tokens[-1] == got[i].n_tokens


def test_every_prefix_and_budget(spark):
    t, rng = Tokenizer.from_file(BYTE), random.Random(3)
    bits = ["a", "'", "r", "e", " ", "  ", "\n", "1", "!", "<|endoftext|>", "<|", "é", "日", "l", "s", "\t", "word", "'re", "don't"]
    texts = ["a  b", "x <|endoftext|> y", "foo!!<|endoftext|><|endoftext|>  \t b<|endoft", "internationalization of the thearsion", "x\x1c\x1c y", "", *("".join(rng.choices(bits, k=25)) for _ in range(150))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for budget in (0, 1, 2, 7):
        rows = token_counts.token_counts(frame, BYTE, with_table=True, budget=budget).withColumn("c", token_counts.chars_within("prefix_tokens", budget)).collect()
        for r in rows:
            s = texts[r.doc_id]
            want = [len(t.encode(s[:k], add_special_tokens=False).ids) for k in range(len(s) + 1)]
            most = max(k for k, n in enumerate(want) if n <= budget)
            assert r.prefix_tokens == want and r.chars_within == r.c == most and r.bytes_within == len(s[:most].encode())


def test_every_prefix_of_a_piece():
    t, c = Tokenizer.from_file(BYTE), token_counts.PrefixCounter(BYTE)
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("thearsionpgdcul") for _ in range(14))
        assert c.prefixes(w.encode()) == [len(t.encode(w[:k], add_special_tokens=False).ids) for k in range(15)]


@pytest.mark.parametrize("kind", ["int", "string", "decimal(12,0)"])
def test_packing_keeps_the_type_of_ids(spark, kind):
    frame = spark.createDataFrame([(None, "a b"), (None, ""), (7, "c d e")], "doc_id int, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text").coalesce(1)
    rows = packing.pack_documents(frame, WORDS)
    assert rows.dtypes[0][1] == kind and sorted(str(r.doc_id) for r in rows.select("doc_id", "doc_tokens").distinct().collect()) == ["7", "None", "None"]


def test_packing(frame, docs):
    t = Tokenizer.from_file(WORDS)
    want = {i: t.encode(s or "", add_special_tokens=False).ids + [2] for i, s in zip(docs.doc_id, docs.text, strict=True)}
    got = packing.pack_documents(frame, WORDS, pool=16).toPandas()
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(want[i]) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(np.array(want[i][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = int(g.length.sum())
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and (total == 4096 or total & (total - 1) == 0)
    assert set(got.doc_id) == set(want)


def test_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        lengths = collections.Counter(rng.randrange(1, 40) for _ in range(9))
        items = list(lengths.elements())
        best = max(s for n in range(10) for c in itertools.combinations(items, n) if (s := sum(c)) <= 100)
        chosen = packing.fill(dict(lengths), 100)
        assert sum(k * n for k, n in chosen) == best and all(n <= lengths[k] for k, n in chosen)


def test_sharding(frame, docs):
    got = sharding.stratified_shards(frame, shards=7).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    n = got.groupby("shard").size()
    assert len(n) == 7 and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.fillna("").groupby(["source", "shard"]).size().unstack(fill_value=0).agg(lambda r: r.max() - r.min(), axis=1).max() <= 2
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got.drop(columns="slot").rename(columns={"size": "bytes"}).itertuples() for r in [type("R", (), {"doc_id": r.doc_id, "size": r.bytes, "text_crc32": r.text_crc32})])


@pytest.mark.parametrize("set_bytes", [1 << 20, 400])
def test_decontamination(spark, frame, docs, set_bytes):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    items = [*zip(bench.item_id.tolist(), bench.text.tolist(), strict=True), (900, "Same text"), (901, None), (902, "?")]
    b = spark.createDataFrame(items, "item_id long, text string")
    win = {}
    for i, s in items:
        w = WORD.findall(lower(s or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(i)
    got = {r.rid: r for r in decontaminate.find_hits(frame, b, set_bytes=set_bytes).collect()}
    for i, s in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(lower(s or ""))
        hit, found = set(), set()
        for n in set(map(len, win)):
            for k in range(len(w) - n + 1):
                if ids := win.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        spans = got[i].word_spans
        assert got[i].n_words == len(w) and {x for a, e in zip(spans[::2], spans[1::2], strict=True) for x in range(a, e)} == hit
        assert got[i].items == sorted(map(str, found))
    if set_bytes > 1000:
        digest = {r.doc_id: r for r in decontaminate.contamination(frame, b).collect()}
        assert all(digest[i].n_hit == sum(r.word_spans[1::2]) - sum(r.word_spans[::2]) for i, r in got.items())
        assert digest[10_001].items_sha256 == hashlib.sha256(b"").hexdigest()
        assert decontaminate.keep_clean(frame, b).count() == sum(not r.word_spans for r in got.values())


def test_window_set_is_small():
    rng = random.Random(4)
    items = [(k, " ".join(f"{rng.randrange(10**6)}" for _ in range(400))) for k in range(800)]
    s = decontaminate.WindowSet(items, 10)
    assert s.nbytes() < 6 * sum(len(t) for _, t in items) + (5 << 20)
    two = decontaminate.WindowSet([(1, "A b C"), (2, "a B c"), (None, "a b c"), (3, "a b d")], 10)
    keys = two.by_width[3][0]
    assert [two.items_of(3, int(k)) for k in sorted(set(keys.tolist()), key=lambda k: -(keys == k).sum())] == [{b"a b c": {"1", "2"}}, {b"a b d": {"3"}}]


def brute_repeats(rows, depth=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if b[k : k + depth] in seen:
                gone[k : k + depth] = b"\1" * depth
            seen.add(b[k : k + depth])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("wide", [256, 2])
def test_suffix_dedup(spark, wide):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["ab", "the", "érr", "xyz", "q", "loooong"]) for _ in range(n))
    base, line, rows = [text(120) for _ in range(4)], text(60), [(-5, "x" * 3000 + "y" * 200)]
    for i in range(150):
        b, kind = rng.choice(base), rng.random()
        p = rng.randrange(len(b))
        rows.append((3 * i, b if kind < 0.2 else b[:p] + "!" + b[p + 1 :] if kind < 0.5 else text(9) + line[rng.randrange(60) :] + text(20) if kind < 0.7 else "a" * rng.randrange(50, 400) if kind < 0.8 else None if kind < 0.85 else text(90)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, wide=wide).collect()}
    assert got == brute_repeats(rows)


def test_radix_groups():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(3900)
    alive, group = suffix_dedup.radix_groups(text, starts, 20)
    got = collections.defaultdict(set)
    for a, g in zip(alive, group, strict=True):
        got[g].add(int(a))
    want = collections.defaultdict(set)
    for s in starts:
        want[text[s : s + 20].tobytes()].add(int(s))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, block):
    # A family most of whose pairs lie just below 0.8: firsts and neighbours of a bucket alone miss links.
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(w)
    bags = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    low = list(range(len(bags)))
    for i in range(len(bags)):
        for j in range(i):
            if len(bags[i] & bags[j]) / len(bags[i] | bags[j]) >= 0.8:
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(low))] == low
    assert 1 < len(set(low)) < len(low)


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [(1000, None), (1001, ""), (1002, "?!"), (1003, "?!"), (1004, "one two"), (1005, "One, two!"), (None, "null id text"), (2000, "rare words only here once")], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            rows.append((n, " ".join(w)))
            n += 1
    bags = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        bags.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if bags[a] and bags[b] and 5 * sum((bags[a] & bags[b]).values()) >= 4 * sum((bags[a] | bags[b]).values()):
            parent[find(b)] = find(a)
    classes = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        classes[find(k)].append(i)
    want = collections.Counter(tuple(sorted(v, key=str)) for v in classes.values())
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    have = collections.defaultdict(list)
    for r in got:
        have[r.class_id].append(r.doc_id)
    assert collections.Counter(tuple(sorted(v, key=str)) for v in have.values()) == want
    assert sum(r.keep for r in got) == len(want)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_few_edges_are_joined_without_rounds(spark, monkeypatch, few):
    # Chains, stars and pairs; the rounds over tables take a dozen jobs at least, the driver a few.
    rng = random.Random(3)
    at = list(range(1, 400))
    rng.shuffle(at)
    links = [(a, b) for a, b in zip(at[:200], at[1:200], strict=False)] + [(at[200], x) for x in at[201:300]] + [(a, b) for a, b in zip(at[300::2], at[301::2], strict=False)] + [(at[0], at[5])]
    low = {x: x for x in range(400)}
    for a, b in links * 400:
        if low[a] == low[b]:
            continue
        x, y = sorted((low[a], low[b]))
        low = {k: x if v == y else v for k, v in low.items()}
    want = dict(low)
    names, root = near_dedup.smallest_reached(*np.array(links).T)
    assert {int(k): int(v) for k, v in zip(names, root, strict=True)} == {k: v for k, v in want.items() if any(k in e for e in links)}
    monkeypatch.setattr(near_dedup, "FEW", few)
    rounds = []
    monkeypatch.setattr(near_dedup, "components", lambda e, f=near_dedup.components: rounds.append(1) or f(e))
    roots = spark.range(400).selectExpr("id AS u", "id AS root")
    got = near_dedup.joined(roots, spark.createDataFrame(links, "u long, v long"))
    assert {r.u: r.root for r in got.collect()} == want
    assert len(rounds) == (not few)
    none = near_dedup.joined(roots, spark.createDataFrame([], "u long, v long"))
    assert all(r.u == r.root for r in none.collect()) and none.count() == 400


def test_small_workers_are_left_alone(monkeypatch):
    # Looking for garbage takes a worker longer than a small task does.
    looked = []
    monkeypatch.setattr("gc.collect", lambda *a: looked.append(1))
    common.trim(1 << 60)
    assert not looked
    common.trim()
    assert looked


def test_bag_minhash_estimates_weighted_jaccard():
    a, b = {k: 1 + k % 7 for k in range(100)}, {k: 1 + 3 * k % 5 for k in range(30, 120)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(120)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(120))
    got = []
    for r in range(25):
        h = lambda x: near_dedup.mix(np.array(list(x), np.uint64) + np.uint64(1000 * r))
        s = near_dedup.bag_minhash(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[h(a), h(b)], np.r_[list(a.values()), list(b.values())], 2, 128)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.03


def test_subsequence_kernel():
    for s, t in (("idiot", "id1iiot"), ("abcabc", "cabcab")):
        want = sum(
            toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
            for i in itertools.combinations(range(len(s)), toxicity.ORDER) for j in itertools.combinations(range(len(t)), toxicity.ORDER)
            if all(s[x] == t[y] for x, y in zip(i, j, strict=True))
        )
        got = toxicity.kernel(toxicity._codes([s], len(s), -1), toxicity._codes([t], len(t), -2))[0, 0]
        assert got == pytest.approx(want, rel=1e-5)


def test_toxicity_held_out(spark):
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    out = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    model = toxicity.train(d[~out].text.tolist(), d[~out].toxic.tolist())
    s = toxicity.Scorer(model)
    scores = s.scores(d[out].text.tolist())
    y = d[out].toxic.to_numpy()
    # Part of the labels is noise; what is found must be right, and found words must survive small changes.
    assert y[scores >= 0.5].mean() > 0.85 and (scores[y == 1] >= 0.5).mean() >= 0.9 and (scores[y == 0] < 0.5).mean() > 0.97
    for lang in ("en", "de", "es", "fr"):
        own = (d[out].lang == lang).to_numpy()
        assert (scores[own & (y == 1)] >= 0.5).mean() >= 0.8 and (scores[own & (y == 0)] < 0.5).mean() >= 0.93
    bad = s.scores(["x idiot y", "i d i o t", "i.d.i.o.t", "st*upid", "you loser", "moron"])
    assert (bad >= 0.5).all() and (s.scores(["", "the quiet house", "lotion idea"]) < 0.5).all()


def test_toxicity_learns_rare_and_short_insults():
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprstvwz") for k in range(rng.randint(4, 9))) for _ in range(6000)]
    rare = ["idiot", "moron", "stupid", "loser", "clown", "trash", "scum", "pathetic", "worthless", "disgusting", "vermin", "cretin", "imbecile", "halfwit", "numbskull", "dimwit", "buffoon", "jackass", "zqx", "wyj"]
    say = lambda *more: " ".join([*rng.choices(words, k=40), *more])
    toxic = [say("blockhead") for _ in range(300)] + [say(w) for w in rare for _ in range(15)]
    clean = [say() for _ in range(2000)]
    s = toxicity.Scorer(toxicity.train(toxic + clean, [1] * len(toxic) + [0] * len(clean)))
    assert (s.scores([say(w) for w in ["blockhead", *rare]]) >= 0.5).all()
    assert (s.scores([say() for _ in range(200)]) >= 0.5).mean() < 0.02


def test_toxicity_finds_joined_insults():
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    d = d[d.lang == "en"]
    s = toxicity.Scorer(toxicity.train(d.text.tolist(), d.toxic.tolist()))
    bad = ["stupid,person", "the/idiot/again", '{"a":"idiot","b":[1,2]}', "http://x.example/you_moron?page=12", "thequietstupidhousebythewater", "q" * 60 + "disgusting" + "q" * 60, "wieder" * 9 + "idiot"]
    assert (s.scores(bad) >= 0.5).all()
    assert (s.scores(["the/quiet/house", '{"a":"lotion","b":[1,2]}', "thequiethousebythewater", "q" * 120]) < 0.5).all()


def test_lm_model_is_witten_bell():
    texts = ["abca abcb", "bca", "", "zzz abc"]
    raw, off = buffers(pa.array(texts))
    table = lm_scoring.symbols(dict(enumerate(np.bincount(raw, minlength=256))))
    _, code = lm_scoring.grams(raw, off, table)
    u, n = np.unique(code, return_counts=True)
    logp = lm_scoring.model(u, n, 0.5)
    v, count = lm_scoring.VOCAB, collections.Counter()
    seqs = [[0, 0, 0, *(int(table[b]) for b in t.encode())] for t in texts]
    for s in seqs:
        for i in range(3, len(s)):
            for k in range(1, 5):
                count[tuple(s[i - k + 1 : i + 1])] += 1

    def p(g):
        if not g:
            return 1 / v
        c = [count[(*g[:-1], w)] for w in range(v)]
        kinds, mass = sum(x > 0 for x in c), 0.5 * sum(c)
        return (0.5 * count[g] + kinds * p(g[1:])) / (mass + kinds) if mass + kinds else p(g[1:])

    for g in [tuple(seqs[0][3:7]), tuple(seqs[3][1:5]), (0, 0, 0, 9), (4, 3, 2, 40)]:
        k = ((g[0] * v + g[1]) * v + g[2]) * v + g[3]
        assert 2.0 ** float(logp[k]) == pytest.approx(p(g), rel=1e-4)


def test_lm_scores_separate(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet")
    got = lm_scoring.cross_entropy_difference(spark.read.parquet(f"{sf}/documents.parquet"), good.where("quality = 1")).join(good, "doc_id").toPandas()
    assert got[got.quality == 1].ce_diff.quantile(0.95) < got[got.quality == 0].ce_diff.quantile(0.05)


def test_lm_scores_every_byte(spark):
    texts = ["tel 12-34 @home", "tel 56=78 'x' j", "Привет мир", "мир и дом", "日本語の本", "日本の家", "the quiet house " * 40, "The House", "", None, "a\tb\nc"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good, v = {0, 2, 4, 6}, 257
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(frame, spark.createDataFrame([(i,) for i in good] + [(2,)], "doc_id long")).collect()}
    seqs = [[0, 0, 0, *(b + 1 for b in (t or "").encode())] for t in texts]
    count = [collections.Counter(), collections.Counter()]
    for d, s in enumerate(seqs):
        for i in range(3, len(s)):
            for k in range(1, 5):
                for m in (0, 1) if d in good else (1,):
                    count[m][tuple(s[i - k + 1 : i + 1])] += 1
    size = [sum(n for g, n in c.items() if len(g) == 1) for c in count]
    after = [collections.defaultdict(list), collections.defaultdict(list)]
    for m in (0, 1):
        for g, n in count[m].items():
            after[m][g[:-1]].append(n)

    def p(m, g):
        if not g:
            return 1 / v
        scale, c = (1, size[0] / size[1])[m], after[m].get(g[:-1], []) if len(g) > 1 else [n for h, n in count[m].items() if len(h) == 1]
        return (scale * count[m][g] + len(c) * p(m, g[1:])) / (scale * sum(c) + len(c)) if c else p(m, g[1:])

    for d, s in enumerate(seqs):
        want = [np.log2(p(1, tuple(s[i - 3 : i + 1])) / p(0, tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))]
        assert got[d].n_tokens == len(want) and got[d].ce_diff == pytest.approx(float(np.mean(want)) if want else 0, rel=1e-6, abs=1e-9)
        for m, name in ((0, "target_loss"), (1, "background_loss")):
            loss = [-np.log2(p(m, tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))]
            assert got[d][name] == pytest.approx(float(np.mean(loss)) if loss else 0, rel=1e-6, abs=1e-9)
    assert len(got) == len(texts)


def test_webp_round_trips():
    rng = np.random.default_rng(0)
    for t in range(25):
        h, w = rng.integers(1, 24, 2)
        px = rng.integers(0, 2**32, (h, w), dtype=np.uint32) if t % 2 else rng.choice(rng.integers(0, 2**32, rng.integers(1, 40), dtype=np.uint32), (h, w))
        tr = [k for k in (0, 1, 2) if rng.random() < 0.5] if t % 2 else [3, *([0] if rng.random() < 0.5 else [])]
        for cache, refs in ((0, False), (0, True), (5, True)):
            assert (webp.decode(webp.encode(px, tuple(tr), cache, refs, seed=t)) == px).all()
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....WEBPVP8 ")
    with pytest.raises(ValueError):
        webp.decode(webp.store(b"abc" * 64)[:60])


def test_webp_reads_foreign_files():
    # Made by another encoder: one transparent pixel, with prefix codes of single symbols.
    file = bytes.fromhex("524946461a000000574542505650384c0d0000002f00000010071011118888fe0700")
    assert webp.decode(file).tolist() == [[0]]
    # By hand: 4 x 1 green pixels 7 7 9 7; green codes 7 -> 0, 9 -> 1, all others single.
    wr = webp.Writer()
    for value, n in ((0x2F, 8), (3, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (7, 8), (9, 8), *[(1, 1), (0, 1), (1, 1), (0, 8)] * 2, (1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 1)):
        wr.bits(value, n)
    assert webp.decode(webp._container(wr.tobytes())).tolist() == [[0xFF000700, 0xFF000700, 0xFF000900, 0xFF000700]]


def test_webp_payloads():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop é", k=7)) for _ in range(300)]
    for text in ["", "a" * 5000, "ab" * 40_000, "hello world! " * 5000, " ".join(rng.choices(words, k=3000)), "".join(map(chr, range(1, 900))) * 9, "x" + "y" * 70_000 + "zqwertuiopasdfghjkl"]:
        payload = webp.payload_of(text)[1]
        media = webp.store(payload)
        grey = (webp.decode(media).ravel() >> np.uint32(8)).astype(np.uint8)
        assert grey[: len(payload)].tobytes() == payload
        assert len(media) < 300 or len(media) < len(payload)
    found = webp._matches(np.frombuffer(b"0123456789abcdefXYZ" + b"0123456789abcdef" + b"--------------------", np.uint8))
    assert found[0] == (19, 16, 19) and found[1][0] == 36 and found[1][2] == 1


def test_media_columns(frame, docs):
    got = {r.doc_id: r for r in webp.media_columns(frame).collect()}
    for i, s in zip(docs.doc_id, docs.text, strict=True):
        n, payload = webp.payload_of(s or "")
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a> <a href=/b>About us</a></nav></header><div class="cookie-notice"><p>We use cookies.</p></div>
<main><article><h1>Real title &amp; more</h1><p>First <b>para</b>graph of text is&nbsp;here with words.<p>Second paragraph goes<br>on here.<script>var x="<p>no</p>"</script></p><div class="ad">Buy now!</div></article>
<section class="comments"><div class="comment"><p>Great article, thanks for it all!</p></div></section></main><aside class=sidebar><p>Popular posts this week</p></aside><form action=x><label>Email</label></form><footer>&copy; us</footer></body></html>"""


def test_html_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(-1, "u", PAGE), (-2, "u", None), (-3, None, ""), (-4, "u", "<p")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(pages.union(extra)).collect()}
    assert got[-1].text == "Real title & more First paragraph of text is here with words. Second paragraph goes on here."
    assert got[-2].text == "" == got[-3].text and got[-2].n_chars == 0
    for r in pages.collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = " ".join(t for t, _, _ in html_text.leaf_blocks(body))
        assert got[r.page_id].text == want


def test_long_and_broken_pages():
    # Each of these took minutes or more with a scanner that starts anew at every "<".
    for part in ("<a ", '<a "', "<div>", "</x>", "<p id='u'>x", "<!-- ", "<x><y></z>", "<![", "<script>", "<div id=u>t"):
        html_text.leaf_blocks(part * 30_000)
    html_text.leaf_blocks("<y><article>" + "<x>" * 30_000 + "</y>" * 30_000 + ">")
    assert html_text.leaf_blocks('<p>one <a title="x>two</a> three <b>four</b><!-- five') == [('one two three four', ("p",), 3 / 18)]
    assert [b[0] for b in html_text.leaf_blocks("<p>a < b <p>c > d <3 <")] == ["a < b", "c > d <3 <"]
    assert html_text.leaf_blocks("<p>" + "word " * 400_000)[0][0] == ("word " * 400_000).strip()


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    net = html_text.BiLSTM(5, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(2, 6, 5)), np.ones((2, 6))
    mask[1, 4:] = 0
    y = rng.integers(0, 2, (2, 6))

    def loss():
        z = net.run(x, mask)
        return float((mask * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() / mask.sum())

    g = net.gradients(x, mask, y)
    for k in ("xf", "hb", "cf", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        down = loss()
        net.p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.03, abs=1e-4)


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in C.STAGES:
        rows = stage(spark, docs, SF)
        if name != "packing":
            assert rows.columns == C.COLUMNS
            kept = rows.toPandas()
            assert set(kept.doc_id) <= ids and kept.doc_id.is_unique
            ids = set(kept.doc_id)
            docs = spark.createDataFrame(kept, docs.schema)
        else:
            assert {r[0] for r in rows.select("doc_id").collect()} == ids


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(12)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprstvwz") for k in range(rng.randint(3, 9))) for _ in range(3000)]
    say = lambda n: rng.choices(words, k=n)
    docs, toxic = {}, set()
    for i in range(0, 260):
        docs[i] = say(rng.randint(20, 60))
    for i in range(260, 330):
        docs[i] = [*say(30), rng.choice(["blockhead", "numbskull"]), *say(20)]
        toxic.add(i)
    base, passage, item = say(80), say(60), say(25)
    for i in range(400, 420):  # near copies
        docs[i] = list(base)
        docs[i][rng.randrange(80)] = "changed"
    for i in range(420, 440):  # a passage that many share
        docs[i] = [*say(30), *passage, *say(30)]
    for i in range(440, 450):  # benchmark text
        docs[i] = [*say(20), *item[: rng.randint(10, 25)], *say(20)]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(330)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    have = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t for i, t, *_ in rows}

    def step(k):
        nonlocal have
        out = C.STAGES[k][1](spark, have, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        have = spark.read.parquet(str(tmp_path / f"stage{k}"))
        return {r.doc_id: r.text for r in have.collect()}

    texts = {i: t for i, t in texts.items() if i not in toxic}
    assert step(0) == texts
    bags = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, (t or "").split()) for i, t in texts.items())}
    first = {i: i for i in texts}
    for i, j in itertools.combinations(sorted(i for i in texts if bags[i]), 2):
        if 5 * len(bags[i] & bags[j]) >= 4 * len(bags[i] | bags[j]):
            low, high = sorted((first[i], first[j]))
            first = {k: low if v == high else v for k, v in first.items()}
    texts = {i: t for i, t in texts.items() if first[i] == i}
    assert {i: t or "" for i, t in step(1).items()} == {i: t or "" for i, t in texts.items()}
    assert 400 in texts and len({k for k in texts if 400 <= k < 420}) < 20
    want = brute_repeats(list(texts.items()))
    got = step(2)
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in got.items()} == {i: v[3] for i, v in want.items() if v[0] != v[1] or not v[0]}
    assert sum(v[1] > 0 for v in want.values()) >= 19
    windows = {tuple(item[k : k + 10]) for k in range(16)}
    left = {i: t for i, t in got.items() if not any(tuple((t or "").split()[k : k + 10]) in windows for k in range(len((t or "").split())))}
    assert step(3) == left and len(left) < len(got)
    pieces = C.STAGES[4][1](spark, have, str(tmp_path)).collect()
    tok = Tokenizer.from_file(WORDS)
    total = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == total and sum(p.length for p in pieces) == sum(total.values())
    again = C.run(spark, str(tmp_path)).collect()
    assert {p.doc_id: p.doc_tokens for p in again} == total
