"""SQL for DuckDB, written by hand: what each registered query must return on the same tables.

Nothing here is shared with the plans; only word lists and the genre table, which are fixed values, are read from where
they are stated.
"""

from __future__ import annotations

from ..functions.stopwords import ENGLISH, STRICT
from ..operators.taxonomy import TAXONOMY


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BOOKS = """books AS (SELECT doc_id AS book_id, split_part(text, chr(10), 1) AS title, source || ', src' || CAST(doc_id % 7 AS VARCHAR) AS authors,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(1850 + (doc_id * 37) % 200 AS DOUBLE) END AS original_publication_year, lang AS language_code,
  1 + (n_chars % 400) / CAST(100 AS DOUBLE) AS average_rating,
  CASE WHEN doc_id % 7 = 2 THEN 'http://img.example/nophoto.png' ELSE 'http://img.example/' || CAST(doc_id AS VARCHAR) END AS image_url, text AS description FROM documents)"""
STOP, STRICT_STOP = _list(ENGLISH), _list(STRICT)
SQUASH = r"trim(regexp_replace({}, '[\s\p{{Z}}\x0B\x1C-\x1F\x85]+', ' ', 'g'))".format
KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))".format
FOLD = r"trim(regexp_replace(lower(regexp_replace(strip_accents(replace(replace({}, chr(8230), '...'), chr(160), ' ')), '[^\x00-\x7F]', '', 'g')), '[^a-z]+', ' ', 'g'))".format
NAMES = "list_filter(list_transform(string_split({}, ','), lambda x: lower(trim(x))), lambda x: x <> '')".format
LETTERS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nl}}\p{{No}}]+')".format
WORDS = r"len(list_filter(regexp_split_to_array(description, '[ \n\t\r\f\x0B]+'), lambda x: x <> ''))"


def flag(text: str) -> str:
    """The language flag of a text, from the counts of a sub-select."""
    tokens = LETTERS(text)
    stop = f"len(list_filter({tokens}, lambda x: list_contains({STRICT_STOP}, x)))"
    letters, ascii_ = f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))", f"length(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"
    ratio = f"CASE WHEN {letters} = 0 THEN 0 ELSE ({letters} - {ascii_}) / CAST({letters} AS DOUBLE) END"
    share = f"CASE WHEN len({tokens}) >= 30 THEN (1 - {stop} / CAST(len({tokens}) AS DOUBLE)) / CAST(0.98 AS DOUBLE) ELSE CAST(0.63 AS DOUBLE) END"
    return f"(CAST(0.7 AS DOUBLE) * ({share}) + CAST(0.3 AS DOUBLE) * (({ratio}) / CAST(0.40 AS DOUBLE)) >= CAST(0.7 AS DOUBLE))"


def sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([BOOKS, *ctes])} {select}"


# Lexical track
FLAGS = f"flags AS (SELECT book_id, title, description, {flag('description')} AS flag FROM books)"
CORPUS = f"""corpus AS (SELECT book_id, flag, list_concat(list_concat(t, t), list_filter(d, lambda x: NOT list_contains({STOP}, x))) AS a FROM (SELECT book_id, flag,
  list_filter(string_split({FOLD('title')}, ' '), lambda x: x <> '') AS t, list_filter(string_split({FOLD("CASE WHEN flag THEN '' ELSE description END")}, ' '), lambda x: x <> '') AS d FROM flags) q)"""


def tfidf(corpus: str = "corpus", fitted: str = "1 = 1", name: str = "lex") -> list[str]:
    """CTEs tf, idf and the weights under `name`; the vocabulary is fitted on the rows of `fitted`."""
    return [
        f"pos AS (SELECT book_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM {corpus})",
        "terms AS (SELECT book_id, w AS term FROM pos UNION ALL SELECT x.book_id, x.w || ' ' || y.w FROM pos x JOIN pos y ON x.book_id = y.book_id AND y.i = x.i + 1)",
        "tf AS (SELECT book_id, term, count(*) AS c FROM terms GROUP BY ALL)",
        f"size AS (SELECT count(*) AS n FROM books WHERE {fitted})",
        f"idf AS (SELECT term, df, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(c) AS cf FROM tf WHERE {fitted} GROUP BY term) t, size WHERE df >= 5 AND df <= 0.9 * n ORDER BY cf DESC, term LIMIT 120000)",
        "w0 AS (SELECT book_id, term, (1 + ln(c)) * idf AS w FROM tf JOIN idf USING (term))",
        f"{name} AS (SELECT book_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY book_id)) AS w FROM w0)",
    ]


LEX = [FLAGS, CORPUS, *tfidf()]

# Authors, numerics, vectors
INC = f"inc AS (SELECT DISTINCT book_id, unnest({NAMES('authors')}) AS author FROM books)"
AUTH = [
    INC,
    "iaf AS (SELECT author, count(*) AS df, ln(((SELECT count(*) FROM books) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS iaf FROM inc GROUP BY author)",
    "aw AS (SELECT book_id, author, iaf / sqrt(sum(iaf * iaf) OVER (PARTITION BY book_id)) AS w FROM inc JOIN iaf USING (author))",
]
NUM = [
    f"raw AS (SELECT book_id, {WORDS} AS words, len({NAMES('authors')}) AS na, average_rating AS r, original_publication_year AS y FROM books)",
    "st AS (SELECT quantile_cont(words, 0.5) AS mw, min(r) AS r0, max(r) AS r1, min(CASE WHEN y IS NOT NULL THEN least(y, 2026) END) AS y0, max(CASE WHEN y IS NOT NULL THEN least(y, 2026) END) AS y1 FROM raw)",
    """num AS (SELECT book_id, y, r, ln(1 + CAST(words AS DOUBLE)) AS f1, CAST(words >= mw AS DOUBLE) AS f2, CAST(na AS DOUBLE) AS f3, CAST(na = 1 AS DOUBLE) AS f4, coalesce((r - r0) / (r1 - r0), 0) AS f5,
      coalesce(CASE WHEN y IS NOT NULL THEN (least(y, 2026) - y0) / (y1 - y0) END, 0) AS f6, coalesce(CAST(y >= 2000 AS DOUBLE), 0) AS f7, coalesce(CAST(y < 1900 AS DOUBLE), 0) AS f8 FROM raw, st)""",
    "nv AS (SELECT book_id, CAST([f1, f2, f3, f4, f5, f6, f7, f8] AS DOUBLE[]) AS v FROM num)",
]
FEATURES = ["desc_len_log1p", "desc_len_ge_median", "author_count_int", "author_single_flag", "average_rating_minmax", "year_norm", "modern_flag", "pre_1900_flag"]
EMB = "emb AS (SELECT vec_id AS book_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings JOIN books ON vec_id = book_id)"
IMG = "img AS (SELECT emb.book_id, list_slice(v, 1, 16) AS v FROM emb JOIN books USING (book_id) WHERE image_url NOT LIKE '%nophoto%')"
COS = "list_dot_product({0}.v, {1}.v) / sqrt(list_dot_product({0}.v, {0}.v) * list_dot_product({1}.v, {1}.v))".format

# Scores of all seeds, percentiles
PAIRS = "pairs AS (SELECT s.book_id AS seed, c.book_id AS cand FROM books s JOIN books c ON s.book_id <> c.book_id WHERE s.book_id % 100 = 0)"


def sparse(name: str, table: str, key: str) -> str:
    return f"{name} AS (SELECT s.book_id AS seed, c.book_id AS cand, sum(s.w * c.w) AS score FROM {table} s JOIN {table} c ON s.{key} = c.{key} WHERE s.book_id % 100 = 0 AND s.book_id <> c.book_id GROUP BY ALL)"


def dense(name: str, table: str) -> str:
    return f"{name} AS (SELECT s.book_id AS seed, c.book_id AS cand, {COS('s', 'c')} AS score FROM {table} s JOIN {table} c ON s.book_id <> c.book_id WHERE s.book_id % 100 = 0)"


SCORES = [
    *LEX, *AUTH, *NUM, EMB, IMG, PAIRS, sparse("lx", "lex", "term"), sparse("ax", "aw", "author"), dense("sem", "emb"), dense("nx", "nv"), dense("ix", "img"),
    "gate AS (SELECT (SELECT count(*) FROM img) / CAST((SELECT count(*) FROM books) AS DOUBLE) >= 0.3 AS open)",
    """scores AS (SELECT p.seed, p.cand, 'tfidf' AS track, round(coalesce(score, 0), 9) AS score FROM pairs p LEFT JOIN lx USING (seed, cand)
      UNION ALL SELECT p.seed, p.cand, 'authors', round(coalesce(score, 0), 9) FROM pairs p LEFT JOIN ax USING (seed, cand)
      UNION ALL SELECT seed, cand, 'semantic', round(score, 9) FROM sem UNION ALL SELECT seed, cand, 'numerics', round(score, 9) FROM nx UNION ALL SELECT seed, cand, 'image', round(score, 9) FROM ix, gate WHERE open)""",
    "pct AS (SELECT seed, cand, track, score, row_number() OVER (PARTITION BY seed, track ORDER BY score, cand) / CAST(count(*) OVER (PARTITION BY seed, track) + 1 AS DOUBLE) AS pct FROM scores)",
    "has AS (SELECT DISTINCT seed, track FROM pct)",
]


def weights(**w: float) -> str:
    rows = ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in w.items())
    return f"(SELECT * FROM (VALUES {rows}) AS t(track, w))"


DEFAULT = {"tfidf": 0.3, "semantic": 0.4, "authors": 0.2, "numerics": 0.1, "image": 0.0}
FUSED = [
    *SCORES,
    f"wt AS {weights(**DEFAULT)}",
    "live AS (SELECT seed, track, w / sum(w) OVER (PARTITION BY seed) AS w FROM has JOIN wt USING (track))",
    "fused AS (SELECT p.seed, p.cand, sum(pct * w) AS fused FROM pct p JOIN live l ON p.seed = l.seed AND p.track = l.track GROUP BY ALL)",
    "ranked AS (SELECT seed, cand, fused, row_number() OVER (PARTITION BY seed ORDER BY round(fused, 9) DESC, cand) AS rk FROM fused)",
]
ERA = "CASE WHEN a.f7 = b.f7 AND a.f8 = b.f8 THEN 1 ELSE 0 END"
BIASED = [
    *FUSED,
    f"biased AS (SELECT seed, cand, fused + CAST(0.02 AS DOUBLE) * {ERA} AS fused FROM fused JOIN num a ON seed = a.book_id JOIN num b ON cand = b.book_id)",
]
TOP = "SELECT seed, cand, score, rk FROM (SELECT seed, cand, round(score, 6) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, cand) AS rk FROM {}) t WHERE rk <= {}".format
NEAR = lambda name, table, k=10: f"{name} AS ({TOP(table, k)})"

# Genres
GENRES = "['Epic Fantasy', 'Space Opera, Dystopia', 'Historical Romance', 'War memoir', 'Poems', 'Cooking', 'Young adult', 'Crime', 'Essays', 'Manga']"
NEEDLES = "needles AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, '{c}', '{n.replace(chr(39), chr(39) * 2)}')" for p, (c, ns) in enumerate(TAXONOMY.items()) for n in ns) + ") AS t(p, category, needle))"
GENRE = [
    NEEDLES,
    f"bg AS (SELECT book_id, unnest(string_split(list_extract({GENRES}, CAST(label % 10 AS INT) + 1), ',')) AS g FROM (SELECT vec_id AS book_id, label FROM embeddings JOIN books ON vec_id = book_id) e)",
    "first AS (SELECT g, min(p) AS p FROM (SELECT DISTINCT lower(trim(g)) AS g FROM bg) x LEFT JOIN needles ON contains(g, needle) GROUP BY g)",
    "coarse AS (SELECT DISTINCT book_id, coalesce(category, 'other') AS c FROM bg JOIN first ON lower(trim(bg.g)) = first.g LEFT JOIN (SELECT DISTINCT p, category FROM needles) n ON n.p = first.p)",
    "combo AS (SELECT book_id, string_agg(c, '|' ORDER BY c) AS combo FROM coarse GROUP BY book_id)",
    "igf AS (SELECT combo, n, ((sum(n) OVER () + 1) / CAST(n + 1 AS DOUBLE)) / max((t + 1) / CAST(n + 1 AS DOUBLE)) OVER () AS igf FROM (SELECT combo, count(*) AS n, sum(count(*)) OVER () AS t FROM combo GROUP BY combo) q)",
    "igf1 AS (SELECT c, n, ((t + 1) / CAST(n + 1 AS DOUBLE)) / max((t + 1) / CAST(n + 1 AS DOUBLE)) OVER () AS igf FROM (SELECT c, count(*) AS n, sum(count(*)) OVER () AS t FROM coarse GROUP BY c) q)",
    "every AS (SELECT book_id, c FROM coarse UNION ALL SELECT book_id, 'other' FROM books WHERE book_id NOT IN (SELECT book_id FROM coarse))",
]


def genre_hits(picks: str) -> str:
    """(all columns of picks, genre) weighted by the candidate's combination."""
    return f"""SELECT p.*, CASE WHEN o.cand IS NULL THEN CAST(0 AS DOUBLE) ELSE coalesce(igf.igf, 1) END AS genre FROM {picks} p
      LEFT JOIN (SELECT DISTINCT p.seed, p.cand FROM {picks} p JOIN every a ON a.book_id = p.seed JOIN every b ON b.book_id = p.cand AND a.c = b.c) o ON p.seed = o.seed AND p.cand = o.cand
      LEFT JOIN combo ON combo.book_id = p.cand LEFT JOIN igf ON igf.combo = coalesce(combo.combo, 'other')"""


def by_settings(settings: str, k: int = 10) -> list[str]:
    """Mean hits per setting (g, track, w) and seed: CTE per_seed (g, seed, genre, yearflag)."""
    return [
        *SCORES, *GENRE, f"settings AS ({settings})",
        "shares AS (SELECT g, seed, track, CASE WHEN sum(greatest(w, 0)) OVER (PARTITION BY g, seed) > 0 THEN greatest(w, 0) / sum(greatest(w, 0)) OVER (PARTITION BY g, seed) ELSE 1 / CAST(count(*) OVER (PARTITION BY g, seed) AS DOUBLE) END AS w FROM has JOIN settings USING (track))",
        "mixed AS (SELECT g, p.seed, cand, sum(pct * w) AS fused FROM pct p JOIN shares s ON p.seed = s.seed AND p.track = s.track GROUP BY ALL)",
        f"chosen AS (SELECT g, seed, cand FROM (SELECT *, row_number() OVER (PARTITION BY g, seed ORDER BY round(fused, 9) DESC, cand) AS rk FROM mixed) t WHERE rk <= {k})",
        f"hits AS ({genre_hits('chosen')})",
        f"per_seed AS (SELECT g, seed, avg(genre) AS genre, avg({ERA}) AS yearflag FROM hits JOIN num a ON a.book_id = seed JOIN num b ON b.book_id = cand GROUP BY g, seed)",
    ]


GRID = "SELECT row_number() OVER (ORDER BY a, b, c, d) AS g, a AS tfidf, b AS semantic, c AS authors, d AS numerics, CAST(0.05 AS DOUBLE) AS image FROM (SELECT CAST(unnest([0.2, 0.4]) AS DOUBLE) AS a) t1, (SELECT CAST(unnest([0.3, 0.5]) AS DOUBLE) AS b) t2, (SELECT CAST(unnest([0.1, 0.3]) AS DOUBLE) AS c) t3, (SELECT CAST(unnest([0.05, 0.15]) AS DOUBLE) AS d) t4"
LONG_GRID = f"UNPIVOT ({GRID}) ON tfidf, semantic, authors, numerics, image INTO NAME track VALUE w"
EVALUATED = "SELECT CAST(g AS INT) AS g, round(avg(genre), 6) AS genre, round(avg(yearflag), 6) AS yearflag, round(0.8 * avg(genre) + 0.2 * avg(yearflag), 6) AS score FROM per_seed GROUP BY g"


def _variants() -> str:
    rows = {"fusion": DEFAULT}
    for t in DEFAULT:
        rest = {x: w for x, w in DEFAULT.items() if x != t}
        rows[f"no_{t}"] = {x: w / sum(rest.values()) for x, w in rest.items()} | {t: 0.0}
    for t in DEFAULT:
        rows[t] = {x: float(x == t) for x in DEFAULT}
    return " UNION ALL ".join(f"SELECT '{g}' AS g, '{t}' AS track, CAST({w!r} AS DOUBLE) AS w" for g, ws in rows.items() for t, w in ws.items())


FUSION_ONLY = " UNION ALL ".join(f"SELECT 'fusion' AS g, '{t}' AS track, CAST({w} AS DOUBLE) AS w" for t, w in DEFAULT.items())

# Lists of neighbours per track
PAIR_NAMES = "(VALUES ('semantic', 'tfidf'), ('semantic', 'authors'), ('semantic', 'numerics'), ('tfidf', 'authors'), ('tfidf', 'numerics'), ('authors', 'numerics'), ('semantic', 'image')) AS names(t1, t2)"


def listed(k: int) -> list[str]:
    """CTEs lists (track, seed, cand, rk), duo (seed, t1, t2), shared."""
    return [
        *SCORES, "every_score AS (SELECT seed, cand, track, score FROM scores WHERE track <> 'image' UNION ALL SELECT seed, cand, 'image', round(score, 9) FROM ix)",
        f"lists AS (SELECT * FROM (SELECT track, seed, cand, row_number() OVER (PARTITION BY seed, track ORDER BY score DESC, cand) AS rk FROM every_score) t WHERE rk <= {k})",
        f"duo AS (SELECT DISTINCT a.seed, t1, t2 FROM {PAIR_NAMES} JOIN lists a ON a.track = t1 JOIN lists b ON b.track = t2 AND a.seed = b.seed)",
        f"shared AS (SELECT a.seed, t1, t2, a.cand, a.rk AS r1, b.rk AS r2 FROM {PAIR_NAMES} JOIN lists a ON a.track = t1 JOIN lists b ON b.track = t2 AND a.seed = b.seed AND a.cand = b.cand)",
        f"jac AS (SELECT duo.seed, duo.t1, duo.t2, count(shared.cand) / CAST({k} AS DOUBLE) AS jaccard FROM duo LEFT JOIN shared USING (seed, t1, t2) GROUP BY ALL)",
        "tau AS (SELECT duo.seed, duo.t1, duo.t2, coalesce(t.tau, CAST(0 AS DOUBLE)) AS tau FROM duo LEFT JOIN (SELECT a.seed, a.t1, a.t2, 1 - 2 * sum(CASE WHEN a.r2 > b.r2 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS tau FROM shared a JOIN shared b ON a.seed = b.seed AND a.t1 = b.t1 AND a.t2 = b.t2 AND a.r1 < b.r1 GROUP BY ALL) t USING (seed, t1, t2))",
        "agree AS (SELECT t1 || '_' || t2 AS pair, avg(jaccard) AS jaccard, avg(tau) AS tau FROM jac JOIN tau USING (seed, t1, t2) GROUP BY ALL)",
    ]


# Positive and negative sets
FOLDED = SQUASH("nfc_normalize(description)")
HASH = f"substr(sha256({FOLDED}), 1, 16)"
KEYS = f"keys AS (SELECT book_id, 'a' AS kind, {NAMES('authors')}[1] AS k FROM books UNION ALL SELECT book_id, 'd', {HASH} FROM books)"
POS = [KEYS, "good AS (SELECT seed, cand FROM (SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY cand) AS r FROM (SELECT DISTINCT a.book_id AS seed, b.book_id AS cand FROM keys a JOIN keys b ON a.kind = b.kind AND a.k = b.k AND a.book_id <> b.book_id WHERE a.book_id % 100 = 0) t) u WHERE r <= 30)"]
NEG = [
    *POS,
    "shuffled AS (SELECT book_id AS cand, row_number() OVER (ORDER BY md5('neg:' || CAST(book_id AS VARCHAR)), book_id) - 1 AS place FROM books)",
    "total AS (SELECT count(*) AS n FROM books)",
    "asked AS (SELECT book_id AS seed, i, (CAST('0x' || substr(md5('start:' || CAST(book_id AS VARCHAR)), 1, 8) AS BIGINT) % n + i) % n AS place FROM books, total, (SELECT unnest(range(0, 90)) AS i) r WHERE book_id % 100 = 0 AND i < least(greatest(n - 1, 1), 90))",
    "bad AS (SELECT seed, cand FROM (SELECT asked.seed, s.cand, row_number() OVER (PARTITION BY asked.seed ORDER BY i) AS r FROM asked JOIN shuffled s USING (place) LEFT JOIN good ON good.seed = asked.seed AND good.cand = s.cand WHERE asked.seed <> s.cand AND good.cand IS NULL) t WHERE r <= 30)",
]


def separated(track: str, table: str) -> str:
    scored = lambda pairs: f"(SELECT round({COS('a', 'b')}, 9) AS s FROM {pairs} p JOIN {table} a ON a.book_id = p.seed JOIN {table} b ON b.book_id = p.cand)"
    return f"SELECT '{track}' AS track, t AS threshold, (SELECT coalesce(avg(CAST(s > t AS DOUBLE)), 0.5) FROM {scored('good')} g) AS separation FROM (SELECT quantile_cont(s, 0.95) AS t FROM {scored('bad')} b) q"


def trials(table: str, scores: str) -> str:
    """Stability of a track's nearest ten in three halves of the rows."""
    return f"""(SELECT n.trial, coalesce(avg(j), 0) AS stability FROM (SELECT unnest([1, 2, 3]) AS trial) n LEFT JOIN (SELECT t.trial, t.seed, count(b.cand) / CAST(10 AS DOUBLE) AS j FROM
      (SELECT * FROM (SELECT trial, seed, cand, row_number() OVER (PARTITION BY trial, seed ORDER BY round(score, 9) DESC, cand) AS rk FROM {scores}, (SELECT unnest([1, 2, 3]) AS trial) x
        WHERE substr(md5(trial || ':' || cand), 1, 8) < '80000000' AND substr(md5(trial || ':' || seed), 1, 8) < '80000000') y WHERE rk <= 10) t
      LEFT JOIN (SELECT seed, cand FROM (SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, cand) AS rk FROM {scores}) z WHERE rk <= 10) b ON b.seed = t.seed AND b.cand = t.cand GROUP BY ALL) u USING (trial) GROUP BY n.trial)"""


CARD = [
    *listed(10), *NEG, f"sep AS ({separated('semantic', 'emb')} UNION ALL {separated('numerics', 'nv')})",
    f"stab AS (SELECT 'semantic' AS track, round(avg(stability), 6) AS s FROM {trials('emb', 'sem')} a UNION ALL SELECT 'numerics', round(avg(stability), 6) FROM {trials('nv', 'nx')} b)",
    "uniq AS (SELECT substr(pair, 10) AS track, round(1 - jaccard, 6) AS u FROM agree WHERE pair LIKE 'semantic_%')",
    "base AS (SELECT * FROM (VALUES ('semantic', 0.45), ('tfidf', 0.25), ('authors', 0.10), ('numerics', 0.10), ('image', 0.10)) AS t(track, baseline))",
    """raw_card AS (SELECT track, CAST(baseline AS DOUBLE) AS baseline, coalesce(s, 0) AS stability, coalesce(round(separation, 6), 0) AS separation, CASE WHEN track = 'semantic' THEN 0 ELSE coalesce(u, 0) END AS uniqueness FROM base LEFT JOIN stab USING (track) LEFT JOIN sep USING (track) LEFT JOIN uniq USING (track))""",
    "capped AS (SELECT *, least(CASE WHEN track = 'image' THEN 0.1 ELSE 0.6 END, greatest(0, 0.4 * stability + 0.4 * separation + 0.1 * uniqueness)) AS raw FROM raw_card)",
    "card AS (SELECT track, baseline, raw / sum(raw) OVER () AS recommended, stability, separation, uniqueness FROM capped)",
]

# Cleaning
TYPO = lambda c: SQUASH(r"regexp_replace(translate({}, '‘’“”–—' || chr(160), chr(39) || chr(39) || '\"\"-- '), '[\x00-\x1F\x7F]', ' ', 'g')".replace('\\"', '"').format(c))
DISCLAIM = lambda c: rf"CASE WHEN regexp_matches({c}, 'not\s+the\s+actual\s+book', 'i') AND regexp_matches({c}, 'full copy of this great book\.', 'i') THEN regexp_replace({c}, '^.*?full copy of this great book\.\s*', '', 'is') ELSE {c} END"
RESOLVE = [
    f"tidy AS (SELECT * REPLACE ({SQUASH('title')} AS title, {SQUASH('authors')} AS authors, {SQUASH('description')} AS description) FROM books)",
    f"k AS (SELECT book_id, {KEY('title')} AS k, unnest({NAMES('authors')}) AS author FROM tidy)",
    "star AS (SELECT k.book_id AS a, m.b FROM k JOIN (SELECT k, author, min(book_id) AS b FROM k GROUP BY k, author) m ON k.k = m.k AND k.author = m.author)",
    "e AS (SELECT a, b FROM star UNION SELECT b, a FROM star)",
    "reach AS (SELECT book_id AS v, book_id AS r FROM books UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.v WHERE reach.r < e.a)",
    "root AS (SELECT v AS book_id, min(r) AS root FROM reach GROUP BY v)",
    "g AS (SELECT root, count(*) AS n, avg(average_rating) AS r FROM tidy JOIN root USING (book_id) GROUP BY root)",
    "rep AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY original_publication_year NULLS LAST, book_id) AS i FROM tidy JOIN root USING (book_id))",
    "al AS (SELECT root, string_agg(DISTINCT author, ', ' ORDER BY author) AS merged FROM k JOIN root USING (book_id) GROUP BY root)",
    "merged AS (SELECT rep.book_id, rep.title, CASE WHEN n > 1 THEN merged ELSE authors END AS authors, g.r AS average_rating, n AS merged_rows, original_publication_year, image_url, description FROM rep JOIN g USING (root) JOIN al USING (root) WHERE i = 1)",
]
CLEAN = [
    *RESOLVE,
    f"typed AS (SELECT * REPLACE ({TYPO('title')} AS title, {DISCLAIM(TYPO('description'))} AS description, CASE WHEN original_publication_year <= 2026 THEN original_publication_year END AS original_publication_year) FROM merged)",
    f"hashed AS (SELECT *, {HASH} AS desc_hash, {flag('description')} AS flagged FROM typed)",
    "clean AS (SELECT *, count(*) OVER (PARTITION BY desc_hash) AS group_size FROM hashed)",
]


def _mmr(rel: list[str], sim: str, k: int, lam: float, reference: bool) -> str:
    """Greedy re-ranking, one pair of CTEs per round; sim is the similarity of books a and b by id."""
    ctes = [*rel, "s0 AS (SELECT seed, cand, rel, CAST(0 AS DOUBLE) AS worst FROM rel)"]
    penalty = "1 - sim" if reference else "sim"
    for t in range(1, k + 1):
        ctes.append(f"p{t} AS (SELECT seed, cand FROM (SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY round(CAST({lam} AS DOUBLE) * rel - CAST({1 - lam!r} AS DOUBLE) * worst, 12) DESC, cand) AS r FROM s{t - 1}) q WHERE r = 1)")
        ctes.append(f"s{t} AS (SELECT s.seed, s.cand, rel, greatest(worst, coalesce({penalty}, 0)) AS worst FROM s{t - 1} s JOIN p{t} p ON p.seed = s.seed AND p.cand <> s.cand LEFT JOIN ({sim.format(pick=f'p{t}')}) m ON m.seed = s.seed AND m.cand = s.cand)")
    return sql(*ctes, select=" UNION ALL ".join(f"SELECT seed, {t} AS rank, cand FROM p{t}" for t in range(1, k + 1)))


def _capped(ctes: list[str], table: str, author: int, desc: int, final: str) -> str:
    """Caps over a ranked table (seed, rk, cand): a recursive walk that carries what is used up."""
    walk = f"""walk AS (SELECT seed, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS cand, CAST([] AS VARCHAR[]) AS au, CAST([] AS VARCHAR[]) AS de, false AS ok FROM (SELECT DISTINCT seed FROM {table}) s
      UNION ALL SELECT w.seed, t.rk, t.cand, CASE WHEN {{ok}} THEN list_append(w.au, t.author) ELSE w.au END, CASE WHEN {{ok}} THEN list_append(w.de, t.h) ELSE w.de END, {{ok}}
      FROM walk w JOIN keyed t ON t.seed = w.seed AND t.rk = w.rk + 1)""".format(ok=f"(len(list_filter(w.au, lambda x: x = t.author)) < {author} AND len(list_filter(w.de, lambda x: x = t.h)) < {desc})")
    keyed = f"keyed AS (SELECT {table}.*, {NAMES('authors')}[1] AS author, {HASH} AS h FROM {table} JOIN books ON book_id = cand)"
    return sql(*ctes, keyed, walk, select=final, recursive=True)


SEM_SIM = f"SELECT x.seed, c.book_id AS cand, {COS('q', 'c')} AS sim FROM {{pick}} x JOIN emb q ON q.book_id = x.cand JOIN emb c ON c.book_id <> x.cand"
REL = [*FUSED, "rel AS (SELECT seed, cand, round(fused, 9) AS rel FROM fused)"]
MAX_SIM = f"""SELECT n.seed, n.cand, greatest(n.sim, coalesce(a.sim, 0)) AS sim FROM (SELECT x.seed, c.book_id AS cand, {COS('q', 'c')} AS sim FROM {{pick}} x JOIN nv q ON q.book_id = x.cand JOIN nv c ON c.book_id <> x.cand) n
  LEFT JOIN (SELECT x.seed, c.book_id AS cand, sum(q.w * c.w) AS sim FROM {{pick}} x JOIN aw q ON q.book_id = x.cand JOIN aw c ON c.author = q.author GROUP BY ALL) a ON a.seed = n.seed AND a.cand = n.cand"""
RESORT = "SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY abs(b.y - a.y) NULLS LAST, rk) AS rk FROM {} JOIN num a ON a.book_id = seed JOIN num b ON b.book_id = cand".format
_chain = _mmr([*BIASED, "rel AS (SELECT seed, cand, fused AS rel FROM biased)"], SEM_SIM, 4, 0.95, True)
_cols = ["title", "authors", "original_publication_year", "language_code", "average_rating", "image_url", "description"]
_kinds = lambda c: f"SELECT '{c}' AS column_name, (SELECT count({c}) FROM books) AS n, (SELECT count(DISTINCT {c}) FROM books) AS kinds, v AS top, f AS freq FROM (SELECT {c} AS v, count(*) AS f FROM books WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY f DESC, v LIMIT 1) t_{c}"
_profile = lambda c, t: f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS low, round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.5), 5) AS mid, round(quantile_cont({c}, 0.75), 5) AS q3, round(max({c}), 5) AS high FROM {t}"
_gini = lambda c, t: f"(SELECT round((n + 1 - 2 * sum(cum) / max(cum)) / n, 6) FROM (SELECT sum(x) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS n FROM (SELECT {c} - least(0, (SELECT min({c}) FROM {t})) AS x FROM {t}) u) v GROUP BY n)"
_ranked = lambda c, t: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def _spearman(cols: list[str], table: str, ctes: list[str]) -> str:
    ranks = f"rr AS (SELECT {', '.join(f'{_ranked(c, table)} AS {c}' for c in cols)} FROM {table})"
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN NULL ELSE round(corr({a}, {b}), 6) END AS rho FROM rr" for i, a in enumerate(cols) for b in cols[i + 1 :])
    return sql(*ctes, ranks, select=pairs)


_era_rows = ", ".join(f"f{i + 1} AS {n}" for i, n in enumerate(FEATURES))
_low = ["desc_len_log1p", "desc_len_ge_median", "author_count_int", "author_single_flag", "average_rating_minmax", "modern_flag", "pre_1900_flag"]
_first = lambda why, where, by: f"SELECT '{why}' AS why, book_id FROM (SELECT book_id FROM books WHERE {where} ORDER BY {by} LIMIT 1) t_{why}"
_digest = "sha256(concat_ws('␟', CAST(book_id AS VARCHAR), CAST(book_id AS VARCHAR), title, description))"

SQL: dict[str, str] = {
    "cache_anti_join": sql(select="SELECT book_id FROM books WHERE book_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY book_id LIMIT 100"),
    "cache_coverage": sql(select="SELECT round(avg(CAST(book_id IN (SELECT vec_id FROM embeddings) AS INT)), 6) AS coverage FROM books"),
    "id_lookup": sql(select="SELECT book_id, title, authors FROM books WHERE book_id = 0 OR book_id = 100 OR book_id = 199"),
    "exact_title_lookup": sql(select="SELECT s.book_id, min(b.book_id) AS found FROM books s JOIN books b ON lower(trim(s.title)) = lower(trim(b.title)) WHERE s.book_id % 100 = 0 GROUP BY s.book_id"),
    "author_flips": sql(select="SELECT book_id, authors FROM books WHERE authors LIKE '%,%' ORDER BY book_id LIMIT 30"),
    "image_mask": sql(select="SELECT count(*) AS n, CAST(sum(CASE WHEN image_url IS NULL OR image_url = '' OR lower(image_url) LIKE '%nophoto%' THEN 1 ELSE 0 END) AS BIGINT) AS placeholders FROM books"),
    "cover_html": sql(select="""SELECT book_id, CASE WHEN image_url LIKE '%nophoto%' THEN '' ELSE '<img src="' || image_url || '" width="90">' END AS html FROM books"""),
    "payload_sha1": sql(select="SELECT book_id, sha1(description) AS sha1 FROM books"),
    "content_digest": sql(
        f"level1 AS (SELECT block, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT {_digest} AS h, row_number() OVER (ORDER BY book_id) - 1 AS i, (row_number() OVER (ORDER BY book_id) - 1) // 4096 AS block FROM books) t GROUP BY block)".replace("CAST(book_id AS VARCHAR), CAST(book_id AS VARCHAR)", "CAST(book_id AS VARCHAR)"),
        select="SELECT CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY block)) END AS digest FROM level1"),
    "text_normalise": sql(select=f"SELECT book_id, md5({SQUASH('title')}) AS title_h, md5({SQUASH('description')}) AS desc_h, lower(image_url) LIKE '%nophoto%' AS placeholder FROM books"),
    "typography": sql("t AS (SELECT book_id, '‘a’ “b”–c—d' || chr(9) || description AS x FROM books)", select=f"SELECT book_id, md5({TYPO('x')}) AS h FROM t"),
    "disclaimer_trim": sql("t AS (SELECT book_id, CASE book_id % 3 WHEN 0 THEN 'This is NOT the actual   book. Buy the full copy of this great book. ' WHEN 1 THEN 'not the actual book: ' ELSE '' END || description AS x FROM books)", select=f"SELECT book_id, md5({DISCLAIM('x')}) AS h FROM t"),
    "title_keys": sql(select=f"SELECT book_id, {KEY('title')} AS title_key, len({NAMES('authors')}) AS n_authors FROM books"),
    "lang_flag": sql(FLAGS, select="SELECT book_id, flag FROM flags"),
    "future_year_decade": sql(select="SELECT book_id, CASE WHEN original_publication_year <= 2026 THEN original_publication_year END AS year, CAST(floor(original_publication_year / 10) * 10 AS BIGINT) AS decade FROM books"),
    "description_length": sql(select=f"SELECT book_id, len({LETTERS('description')}) AS desc_len FROM books"),
    "ascii_folded_titles": sql(select=f"SELECT book_id, {FOLD('title')} AS title FROM books"),
    "authors_canonical": sql(select="SELECT book_id, 'First Last ' || split_part(authors, ',', 1) || '|A and B, C' AS after FROM books"),
    "authors_changed": sql(select="SELECT book_id, 'X ' || split_part(authors, ',', 1) AS after, (SELECT round(avg(CASE WHEN book_id % 4 = 0 THEN 1.0 ELSE 0 END), 6) FROM books) AS share FROM books WHERE book_id % 4 = 0 ORDER BY book_id LIMIT 10"),
    "entity_resolution": sql(*[c.replace("FROM tidy", "FROM books") for c in RESOLVE[1:]], select="SELECT book_id, authors, round(average_rating, 6) AS average_rating, merged_rows FROM merged", recursive=True),
    "clean_books": sql(*CLEAN, recursive=True, select=f"SELECT book_id, md5(title) AS title_h, authors, len({NAMES('authors')}) AS n_authors, original_publication_year, round(average_rating, 6) AS average_rating, md5(description) AS description_h, flagged AS desc_suspected_non_english, desc_hash, group_size AS desc_group_size, group_size > 1 AS desc_is_shared FROM clean"),
    "run_manifest": sql(*CLEAN, recursive=True, select="SELECT count(*) AS n_rows, round(100 * avg(CAST(flagged AS DOUBLE)), 6) AS non_en_pct, round(100 * avg(CAST(image_url LIKE '%nophoto%' AS DOUBLE)), 6) AS covers_missing_pct, count(DISTINCT desc_hash) AS desc_groups, round(100 * avg(CAST(group_size > 1 AS DOUBLE)), 6) AS desc_shared_pct FROM clean"),
    "null_report": sql(select=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS total, round(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE), 4) AS pct FROM books" for c in ["book_id", *_cols])),
    "profile_numeric": sql(select=" UNION ALL ".join([_profile("original_publication_year", "books"), _profile("average_rating", "books"), _profile("o_totalprice", "orders"), _profile("c_acctbal", "customer")])),
    "profile_categorical": sql(select=" UNION ALL ".join(_kinds(c) for c in ("language_code", "authors", "image_url"))),
    "value_counts_topk": sql(select="SELECT language_code, count(*) AS n FROM books GROUP BY language_code ORDER BY n DESC, language_code LIMIT 10"),
    "unusual_chars": sql(select=r"""SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(description, '[^a-zA-Z0-9\s.,:;!?''\-()\[\]/&]')) AS ch FROM books) t GROUP BY ch ORDER BY n DESC, ch LIMIT 30"""),
    "vocab_size": sql(select=rf"SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(regexp_extract_all(lower(description), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS w FROM books) t WHERE length(w) >= 2 AND NOT list_contains({STOP}, w)"),
    "skew_kurt": sql(select="SELECT count(*) AS n, round(sum(power(z, 3)) / count(*), 6) AS skew, round(sum(power(z, 4)) / count(*) - 3, 6) AS kurt FROM (SELECT (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders) t"),
    "gini": sql(select=f"SELECT {_gini('l_quantity', 'lineitem')} AS quantity, {_gini('c_acctbal', 'customer')} AS balance"),
    "lognormalish": sql("s AS (SELECT round(sum(power(z, 3)) / count(*), 6) AS skew FROM (SELECT (length(description) - avg(length(description)) OVER ()) / stddev_pop(length(description)) OVER () AS z FROM books) t)", f"l AS (SELECT length(description) AS x FROM books), gg AS (SELECT {_gini('x', 'l')} AS gini)", select="SELECT skew, gini, skew > 1 OR gini > 0.5 AS lognormalish FROM s, gg"),
    "feature_ratios": sql(select="SELECT round(avg(CASE WHEN original_publication_year IS NULL THEN 1.0 ELSE 0 END), 6) AS year_nan, round(count(DISTINCT authors) / CAST(count(*) AS DOUBLE), 6) AS author_unique, round((SELECT max(n) FROM (SELECT count(*) AS n FROM books GROUP BY language_code) t) / CAST(count(*) AS DOUBLE), 6) AS language_top_share, quantile_cont(length(description), 0.5) AS median_length, (SELECT count(*) FROM books WHERE length(description) > (SELECT quantile_cont(length(description), 0.5) FROM books)) AS above_median FROM books"),
    "feature_actions": sql(
        f"k AS (SELECT book_id, {KEY('title')} AS k, unnest({NAMES('authors')}) AS author FROM books)", f"l AS (SELECT CAST({WORDS} AS DOUBLE) AS x FROM books), s AS (SELECT (SELECT sum(power(z, 3)) / count(*) FROM (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM l) t) AS skew, {_gini('x', 'l')} AS gini)",
        select="""SELECT 'book_id' AS feature, 'keep' AS action UNION ALL SELECT 'original_publication_year', CASE WHEN avg(CASE WHEN original_publication_year IS NULL THEN 1.0 ELSE 0 END) > 0.1 THEN 'consider_imputation' ELSE 'keep' END FROM books
          UNION ALL SELECT 'average_rating', 'keep' UNION ALL SELECT 'language_code', CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM books GROUP BY language_code) t) >= 0.5 * (SELECT count(*) FROM books) THEN 'drop' ELSE 'keep_but_downweight' END
          UNION ALL SELECT 'desc_length', CASE WHEN skew > 1 OR gini > 0.5 THEN 'derive_log1p_and_binary' ELSE 'zscore_and_binary' END FROM s UNION ALL SELECT 'author_count', 'derive_integer_and_binary'
          UNION ALL SELECT 'original_publication_year', 'derive_decade_and_modern_flag' UNION ALL SELECT 'average_rating', CASE WHEN max(average_rating) - min(average_rating) <= 2 OR stddev_pop(average_rating) < 0.4 THEN 'keep_raw_and_add_minmax_0_1' ELSE 'zscore' END FROM books
          UNION ALL SELECT 'dedupe_policy', CASE WHEN EXISTS (SELECT 1 FROM k GROUP BY k, author HAVING count(DISTINCT book_id) > 1) THEN 'apply_cleaning_rules_before_model' ELSE 'no_extra_dedupe_needed' END UNION ALL SELECT '__model_level__', 'normalize_numeric_for_distance_models'"""),
    "histogram_rating": sql(select="SELECT CAST(floor((average_rating - 1) / 0.25) AS INT) AS bin, count(*) AS n FROM books GROUP BY 1"),
    "dup_exact": sql(select="SELECT book_id, n FROM (SELECT book_id, count(*) OVER (PARTITION BY title, authors) AS n FROM books) t WHERE n > 1"),
    "dup_same_desc": sql(select="""SELECT md5(description) AS h, count(*) AS n_rows, min_by(CASE WHEN length(description) > 80 THEN substr(description, 1, 80) || '…' ELSE description END, book_id) AS sample, count(DISTINCT title) AS titles,
        (SELECT coalesce(string_agg(x, '|' ORDER BY x), '') FROM (SELECT unnest(list(DISTINCT authors)) AS x)) AS authors, (SELECT coalesce(string_agg(CAST(x AS VARCHAR), '|' ORDER BY x), '') FROM (SELECT unnest(list(DISTINCT CAST(original_publication_year AS INT)) FILTER (WHERE original_publication_year IS NOT NULL)) AS x)) AS years,
        string_agg(CAST(book_id AS VARCHAR), '|' ORDER BY book_id) AS book_ids FROM books GROUP BY md5(description) HAVING count(*) > 1"""),
    "desc_hash_groups": sql(select=f"SELECT {HASH} AS desc_hash, count(*) AS n_rows, string_agg(CAST(book_id AS VARCHAR), '|' ORDER BY book_id) AS book_ids FROM books GROUP BY 1 HAVING count(*) > 1"),
    "dup_title_author_pairs": sql(f"k AS (SELECT book_id, {KEY('title')} AS k, unnest({NAMES('authors')}) AS author FROM books)", select="SELECT DISTINCT first AS a, book_id AS b FROM (SELECT book_id, min(book_id) OVER (PARTITION BY k, author) AS first FROM k) t WHERE first < book_id"),
    "desc_groups": sql(select="SELECT book_id, count(*) OVER (PARTITION BY md5(description)) AS desc_group_size FROM books"),
    "dedupe_summary": sql(
        *CLEAN,
        "n1 AS (SELECT (SELECT count(*) FROM books) AS rows_before, (SELECT count(*) FROM clean) AS rows_after, (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY title, authors) AS n FROM books) t WHERE n > 1) AS exact_before, (SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY title, authors) AS n FROM clean) t WHERE n > 1) AS exact_after)",
        *[f"{n}_k AS (SELECT book_id, {KEY('title')} AS k, unnest({NAMES('authors')}) AS author FROM {n})" for n in ("books", "clean")],
        "n2 AS (SELECT " + ", ".join(f"(SELECT count(*) FROM (SELECT DISTINCT first, book_id FROM (SELECT book_id, min(book_id) OVER (PARTITION BY k, author) AS first FROM {n}_k) t WHERE first < book_id) u) AS overlap_{w}" for n, w in (("books", "before"), ("clean", "after"))) + ")",
        "n3 AS (SELECT " + ", ".join(f"(SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY md5(description) HAVING count(*) > 1) t) AS shared_{w}" for n, w in (("books", "before"), ("clean", "after"))) + ")",
        recursive=True,
        select="SELECT *, " + ", ".join(f"CASE WHEN {x}_before > 0 THEN round(greatest(0, {x}_before - {x}_after) / CAST({x}_before AS DOUBLE) * 100, 4) ELSE 100.0 END AS {x}_removed_pct" for x in ("exact", "overlap", "shared")) + " FROM n1, n2, n3"),
    "spearman": _spearman(["l_quantity", "l_discount", "l_extendedprice"], "lineitem", []),
    "numeric_spearman": _spearman(_low, "feat", [*NUM, f"feat AS (SELECT {_era_rows} FROM num)"]),
    "dataset_manifest": sql(select=f"SELECT count(*) AS n_rows, round(avg(CASE WHEN image_url LIKE '%nophoto%' THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS no_cover, count(DISTINCT {HASH}) AS kinds FROM books"),
    "tfidf_corpus": sql(FLAGS, CORPUS, select="SELECT book_id, flag, len(a) AS tokens, md5(array_to_string(a, ' ')) AS h FROM corpus"),
    "tfidf_vocabulary": sql(*LEX, select="SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "tfidf_weights": sql(*LEX, select="SELECT book_id, count(*) AS terms, round(sum(w), 5) AS total, round(max(w), 6) AS top FROM lex GROUP BY book_id"),
    "tfidf_transform": sql(FLAGS, CORPUS, *tfidf(fitted="book_id % 5 <> 0"), select="SELECT books.book_id, count(lex.term) AS terms, round(coalesce(sum(w), 0), 5) AS total FROM books LEFT JOIN lex ON lex.book_id = books.book_id WHERE books.book_id % 5 = 0 GROUP BY books.book_id"),
    "tfidf_top_terms": sql(*LEX, select="SELECT book_id, term, rk FROM (SELECT book_id, term, row_number() OVER (PARTITION BY book_id ORDER BY round(w, 9) DESC, term) AS rk FROM lex) t WHERE rk <= 15"),
    "tfidf_sparsity": sql(*LEX, select="SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_nnz, round(avg(CAST(n < 3 AS DOUBLE)), 6) AS ultra_sparse FROM (SELECT books.book_id, count(lex.term) AS n FROM books LEFT JOIN lex USING (book_id) GROUP BY books.book_id) t"),
    "tfidf_extremes": sql(*LEX, select="SELECT 'rare' AS which, term, df, round(idf, 6) AS idf FROM (SELECT * FROM idf ORDER BY df, term LIMIT 20) a UNION ALL SELECT 'common', term, df, round(idf, 6) FROM (SELECT * FROM idf ORDER BY df DESC, term LIMIT 20) b"),
    "semantic_corpus": sql(select="SELECT book_id, md5(trim(title || chr(10) || description)) AS h FROM books"),
    "authors_iaf": sql(*AUTH, select="SELECT author, df, round(iaf, 6) AS iaf FROM iaf"),
    "authors_weights": sql(*AUTH, select="SELECT book_id, author, round(w, 6) AS w FROM aw"),
    "numeric_features": sql(*NUM, select="SELECT book_id, " + ", ".join(f"round(f{i + 1}, 6) AS {n}" for i, n in enumerate(FEATURES)) + " FROM num"),
    "numeric_variance": sql(*NUM, f"feat AS (SELECT {_era_rows} FROM num)", select=" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS variance, var_samp({c}) < 0.01 AS low FROM feat" for c in _low)),
    "coverage_gates": sql(EMB, IMG, select="SELECT round(i, 6) AS image, i >= 0.3 AS image_ok, round(g, 6) AS genre, g >= 0.1 AS genre_ok, g >= 0.05 AS genre_usable FROM (SELECT (SELECT count(*) FROM img) / CAST(count(*) AS DOUBLE) AS i, (SELECT count(*) FROM emb) / CAST(count(*) AS DOUBLE) AS g FROM books) t"),
    "vector_health": sql(EMB, "norms AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM emb)", select="SELECT count(*) AS n, round(min(n), 5) AS low, round(quantile_cont(n, 0.5), 5) AS mid, round(max(n), 5) AS high, count(*) FILTER (WHERE n < 1e-6) AS near_zero FROM norms"),
    "norm_outliers": sql(EMB, IMG, select=" UNION ALL ".join(f"SELECT '{t}' AS track, (SELECT round(avg(CAST(abs(n - m) / (mad + 1e-9) > 5 AS DOUBLE)), 6) FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM {c}) a, (SELECT m, quantile_cont(abs(n - m), 0.5) AS mad FROM (SELECT sqrt(list_dot_product(v, v)) AS n FROM {c}) b, (SELECT quantile_cont(sqrt(list_dot_product(v, v)), 0.5) AS m FROM {c}) d GROUP BY m) e) AS share" for t, c in (("semantic", "emb"), ("image", "img")))),
    "lexical_topk": sql(*LEX, PAIRS, sparse("lx", "lex", "term"), "full_lx AS (SELECT p.seed, p.cand, coalesce(score, 0) AS score FROM pairs p LEFT JOIN lx USING (seed, cand))", select=TOP("full_lx", 10)),
    "cosine_dense_topk": sql(EMB, dense("sem", "emb"), select=TOP("sem", 10)),
    "cosine_sparse_topk": sql(*AUTH, PAIRS, sparse("ax", "aw", "author"), "full_ax AS (SELECT p.seed, p.cand, coalesce(score, 0) AS score FROM pairs p LEFT JOIN ax USING (seed, cand))", select=TOP("full_ax", 10)),
    "nearest_table": sql(EMB, dense("sem", "emb"), NEAR("near", "sem"), select=f"SELECT seed, cand, rk, score AS cosine, list_has_any({NAMES('a.authors')}, {NAMES('b.authors')}) AS shared_author, round(b.original_publication_year - a.original_publication_year, 6) AS d_year, round(b.average_rating - a.average_rating, 6) AS d_rating FROM near JOIN books a ON a.book_id = seed JOIN books b ON b.book_id = cand"),
    "author_dominance": sql(*AUTH, PAIRS, sparse("ax", "aw", "author"), "full_ax AS (SELECT p.seed, p.cand, coalesce(score, 0) AS score FROM pairs p LEFT JOIN ax USING (seed, cand))", NEAR("near", "full_ax"), select=f"SELECT seed, round(avg(CAST(list_has_any({NAMES('a.authors')}, {NAMES('b.authors')}) AS DOUBLE)), 6) AS share, avg(CAST(list_has_any({NAMES('a.authors')}, {NAMES('b.authors')}) AS DOUBLE)) > 0.6 AS dominated FROM near JOIN books a ON a.book_id = seed JOIN books b ON b.book_id = cand GROUP BY seed"),
    "rank_percentile": sql(*SCORES, select="SELECT seed, track, count(*) AS n, round(min(pct), 6) AS low, round(max(pct), 6) AS high, CAST(sum(CASE WHEN pct > 0.9 THEN cand ELSE 0 END) AS BIGINT) AS top_sum FROM pct GROUP BY seed, track"),
    "fused_topk": sql(*FUSED, select="SELECT seed, cand, round(fused, 6) AS fused, rk FROM ranked WHERE rk <= 5"),
    "fused_topk_year_bias": sql(*BIASED, select="SELECT seed, cand, round(fused, 6) AS fused, rk FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(fused, 9) DESC, cand) AS rk FROM biased) t WHERE rk <= 5"),
    "fused_per_candidate": sql(*FUSED, "pc AS (SELECT seed, cand, sum(pct * w) / sum(w) AS fused FROM pct JOIN wt USING (track) GROUP BY ALL)", select='SELECT seed, rank, cand, round(fused, 6) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(fused, 9) DESC, cand) AS rank FROM pc) t WHERE rank <= 5'),
    "year_resort": sql(*FUSED, "five AS (SELECT * FROM ranked WHERE rk <= 5)", f"again AS ({RESORT('five')})", select="SELECT seed, cand, rk AS new_rk FROM again"),
    "contrib_explain": sql(*FUSED, select="SELECT r.seed, r.cand, r.rk, wt.track, round(coalesce(p.pct, 0) * wt.w, 6) AS contrib FROM ranked r CROSS JOIN wt LEFT JOIN pct p ON p.seed = r.seed AND p.cand = r.cand AND p.track = wt.track WHERE r.rk <= 5"),
    "explain_table": sql(*FUSED, select="SELECT r.seed, r.rk AS rank, r.cand, " + ", ".join(f"round(coalesce(sum(p.pct * wt.w) FILTER (WHERE p.track = '{t}'), 0), 6) AS {t}_part" for t in DEFAULT) + ", round(sum(p.pct * wt.w), 6) AS fused_sum FROM ranked r JOIN pct p ON p.seed = r.seed AND p.cand = r.cand JOIN wt ON wt.track = p.track WHERE r.rk <= 5 GROUP BY r.seed, r.rk, r.cand"),
    "numeric_contrib": sql(*FUSED, "unit AS (SELECT book_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM nv)", f"pos8 AS (SELECT unnest({_list(FEATURES)}) AS feature, generate_subscripts({_list(FEATURES)}, 1) AS i)", select="SELECT seed, cand, feature, round(a.v[i] * b.v[i], 6) AS contrib FROM ranked JOIN unit a ON a.book_id = seed JOIN unit b ON b.book_id = cand, pos8 WHERE rk <= 5"),
    "caps_greedy": _capped([*FUSED, "twenty AS (SELECT seed, cand, rk FROM ranked WHERE rk <= 20)"], "twenty", 3, 1, "SELECT seed, CAST(rk AS INT) AS rank, cand FROM walk WHERE ok"),
    "mmr_rerank": _mmr(REL, SEM_SIM, 4, 0.95, True),
    "mmr_standard": _mmr(REL, MAX_SIM, 4, 0.9, False),
    "recommend_chain": "",
    "serve_final": "",
    "coarse_genres": sql(*GENRE, select="SELECT book_id, combo FROM combo"),
    "taxonomy_order": sql(NEEDLES, "q AS (SELECT needle, lower(needle) AS one, lower(needle || ' / ' || reverse(needle)) AS two FROM needles)", select="SELECT q.needle, " + ", ".join(f"coalesce((SELECT arg_min(category, p) FROM needles m WHERE contains(q.{x}, m.needle)), 'other') AS {n}" for x, n in (("one", "c"), ("two", "c2"))) + " FROM q"),
    "igf_combo": sql(*GENRE, select="SELECT combo, n, round(igf, 6) AS igf FROM igf"),
    "igf_genre": sql(*GENRE, select="SELECT c AS key, n, round(igf, 6) AS igf FROM igf1"),
    "genre_at_k": sql(*FUSED, *GENRE, "ten AS (SELECT seed, cand FROM ranked WHERE rk <= 10)", f"gh AS ({genre_hits('ten')})", select="SELECT seed, round(avg(genre), 6) AS genre_at_k FROM gh GROUP BY seed"),
    "genre_at_k_single": sql(*FUSED, *GENRE, "ten AS (SELECT seed, cand FROM ranked WHERE rk <= 10)", "gh AS (SELECT p.seed, p.cand, avg(coalesce(igf1.igf, 1)) AS genre FROM ten p JOIN every a ON a.book_id = p.seed JOIN every b ON b.book_id = p.cand AND a.c = b.c LEFT JOIN igf1 ON igf1.c = a.c GROUP BY ALL)", select="SELECT ten.seed, round(avg(coalesce(genre, 0)), 6) AS genre_at_k FROM ten LEFT JOIN gh USING (seed, cand) GROUP BY ten.seed"),
    "yearflag_at_k": sql(*FUSED, select=f"SELECT seed, round(avg({ERA}), 6) AS yearflag FROM ranked JOIN num a ON a.book_id = seed JOIN num b ON b.book_id = cand WHERE rk <= 10 GROUP BY seed"),
    "rating_drift": sql(*FUSED, select="SELECT seed, round(coalesce(avg(CASE WHEN abs(b.r - a.r) > 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE a.r IS NOT NULL AND b.r IS NOT NULL), 0), 6) AS drift FROM ranked JOIN num a ON a.book_id = seed JOIN num b ON b.book_id = cand WHERE rk <= 10 GROUP BY seed"),
    "weight_grid": f"SELECT CAST(g AS INT) AS g, tfidf, semantic, authors, numerics, image FROM ({GRID}) t",
    "fine_sweep": "SELECT DISTINCT " + ", ".join(f"round(round({t} / s, 9), 3) AS {t}" for t in DEFAULT) + " FROM (SELECT *, " + " + ".join(DEFAULT) + " AS s FROM " + ", ".join(f"(SELECT greatest(0, CAST({w} AS DOUBLE) + unnest([CAST(-0.05 AS DOUBLE), 0, 0.05])) AS {t}) t_{t}" for t, w in DEFAULT.items()) + ") q WHERE s > 0",
    "grid_eval": sql(*by_settings(LONG_GRID), select=EVALUATED),
    "best_weights": sql(*by_settings(LONG_GRID), f"ev AS ({EVALUATED})", select=f"SELECT tfidf, semantic, authors, numerics, image, score FROM ev JOIN ({GRID}) gr USING (g) ORDER BY score DESC, g LIMIT 1"),
    "ablation": sql(*by_settings(_variants()), select="SELECT g AS setting, round(avg(genre), 6) AS genre, round(avg(yearflag), 6) AS yearflag FROM per_seed GROUP BY g"),
    "mmr_on_off": "",
    "seed_winners": sql(*by_settings(_variants()), select="SELECT seed, winner, round(combo, 6) AS combo FROM (SELECT seed, g AS winner, 0.7 * genre + 0.3 * yearflag AS combo, row_number() OVER (PARTITION BY seed ORDER BY round(0.7 * genre + 0.3 * yearflag, 9) DESC, g) AS r FROM per_seed WHERE g NOT LIKE 'no_%') t WHERE r = 1"),
    "worst_seeds": sql(*by_settings(FUSION_ONLY), select="SELECT seed, round(yearflag, 6) AS yearflag FROM per_seed ORDER BY round(yearflag, 6), seed LIMIT 20"),
    "group_eval": sql(*by_settings(FUSION_ONLY), "gr AS (SELECT CASE WHEN n.f8 = 1 THEN 'outlier' ELSE 'random' END AS seed_group, count(*) AS n, avg(genre) AS genre, avg(yearflag) AS yearflag FROM per_seed JOIN num n ON n.book_id = seed GROUP BY 1)", select="SELECT seed_group, n, round(genre, 6) AS genre, round(yearflag, 6) AS yearflag, (max(genre) OVER () - min(genre) OVER () >= 0.1 OR max(genre) OVER () >= 2 * min(genre) OVER ()) AS gap_wide FROM gr"),
    "jaccard_at_k": sql(*listed(10), select="SELECT seed, t1, t2, round(jaccard, 6) AS jaccard FROM jac"),
    "kendall_tau": sql(*listed(100), select="SELECT seed, t1, t2, round(tau, 6) AS tau FROM tau"),
    "agreement": sql(*listed(10), select="SELECT pair, round(jaccard, 6) AS jaccard, round(tau, 6) AS tau FROM agree"),
    "agreement_messages": sql(*listed(10), "said AS (SELECT pair, CASE WHEN jaccard < 0.25 THEN 'low' WHEN jaccard > 0.8 THEN 'very high' ELSE 'good' END AS jaccard_is, CASE WHEN tau < 0.15 THEN 'low' WHEN tau > 0.7 THEN 'very high' ELSE 'good' END AS tau_is FROM agree)", select="SELECT *, CASE WHEN jaccard_is = 'good' AND tau_is = 'good' THEN 'good agreement' WHEN 'very high' IN (jaccard_is, tau_is) THEN 'redundant: adjust fusion weights' ELSE 'low agreement: adjust fusion weights or thresholds' END AS note FROM said"),
    "uniqueness": sql(*listed(10), select="SELECT substr(pair, 10) AS track, round(1 - jaccard, 6) AS uniqueness FROM agree WHERE pair LIKE 'semantic_%'"),
    "scorecard": sql(*CARD, select="SELECT track, round(baseline, 6) AS baseline, round(recommended, 6) AS recommended, round(stability, 6) AS stability, round(separation, 6) AS separation, round(uniqueness, 6) AS uniqueness FROM card"),
    "weight_deltas": sql(*CARD, select="SELECT track, round(recommended - baseline, 6) AS delta FROM card WHERE abs(recommended - baseline) >= 0.05"),
    "diversity_hhi": sql(*LEX, PAIRS, sparse("lx", "lex", "term"), "full_lx AS (SELECT p.seed, p.cand, coalesce(score, 0) AS score FROM pairs p LEFT JOIN lx USING (seed, cand))", NEAR("near", "full_lx"), select="SELECT seed, round(sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE), 6) AS hhi, round(coalesce(max(hi) - min(lo), 0), 6) AS year_range FROM (SELECT seed, authors, count(*) AS n, max(original_publication_year) AS hi, min(original_publication_year) AS lo FROM near JOIN books ON book_id = cand GROUP BY seed, authors) t GROUP BY seed"),
    "diversity_messages": "",
    "stability_md5": sql(EMB, dense("sem", "emb"), select=f"SELECT trial, round(stability, 6) AS stability FROM {trials('emb', 'sem')} t"),
    "random_seeds": sql(select="SELECT book_id AS seed FROM books ORDER BY md5('7:' || book_id), book_id LIMIT least(50, (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM books))"),
    "positive_sets": sql(*POS, select="SELECT seed, cand FROM good"),
    "negative_samples": sql(*NEG, select="SELECT seed, cand FROM bad"),
    "separation_p95": sql(EMB, *NUM, *NEG, select=f"SELECT track, round(threshold, 6) AS threshold, round(separation, 6) AS separation FROM ({separated('semantic', 'emb')} UNION ALL {separated('numerics', 'nv')}) t"),
    "pair_masks": sql(KEYS, select="SELECT CAST(sum(n * (n - 1)) FILTER (WHERE kind = 'a') AS BIGINT) AS same_author, CAST(sum(n * (n - 1)) FILTER (WHERE kind = 'd') AS BIGINT) AS same_description, (SELECT count(*) * (count(*) - 1) FROM books) - CAST(sum(n * (n - 1)) FILTER (WHERE kind = 'a') AS BIGINT) AS other_author FROM (SELECT kind, k, count(*) AS n FROM keys GROUP BY ALL) t"),
    "seed_picker": sql(
        "odd AS (" + " UNION ALL ".join([_first("no_description", "coalesce(description, '') = ''", "book_id"), _first("pre1900", "original_publication_year < 1900", "book_id"), _first("modern", "original_publication_year >= 2000", "book_id"), _first("no_cover", "image_url LIKE '%nophoto%'", "book_id"), _first("top_rated", "true", "coalesce(average_rating, -1e9) DESC, length(description) DESC, book_id")]) + ")",
        "merged_odd AS (SELECT book_id, string_agg(why, '+' ORDER BY why) AS why FROM odd GROUP BY book_id)",
        select="SELECT book_id, why FROM merged_odd UNION ALL SELECT book_id, 'random' FROM (SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM odd) ORDER BY md5('42:' || book_id), book_id LIMIT 20) r"),
    "interpretability_seeds": sql(
        f"w AS (SELECT book_id, {WORDS} AS w, len({NAMES('authors')}) AS a FROM books)",
        select=" UNION ALL ".join([*[f"SELECT '{n}' AS why, book_id FROM (SELECT book_id FROM w ORDER BY {o}, book_id LIMIT 1) t_{n}" for n, o in (("shortest", "w"), ("longest", "w DESC"), ("fewest_authors", "a"))], _first("no_cover", "image_url LIKE '%nophoto%'", "book_id"), _first("oldest", "true", "original_publication_year NULLS LAST, book_id"), "SELECT 'random' AS why, book_id FROM (SELECT book_id FROM books ORDER BY md5('123:' || book_id), book_id LIMIT 5) r"])),
}

# The whole chains: re-ranked or plain picks, by year, capped.
_after = lambda picks: [f"again AS ({RESORT(picks)})"]
_end = "SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY rk) AS INT) AS rank, cand, round(fused, 6) AS fused FROM walk JOIN biased USING (seed, cand) WHERE ok"
_picked = [c for c in _chain[len("WITH ") + len(BOOKS) + 2 : _chain.index(" SELECT seed, 1 AS rank")].split("\x00")]
SQL["recommend_chain"] = _capped([*_picked, "four AS (" + " UNION ALL ".join(f"SELECT seed, {t} AS rk, cand FROM p{t}" for t in range(1, 5)) + ")", *_after("four")], "again", 3, 1, _end)
SQL["serve_final"] = _capped([*BIASED, "five AS (SELECT seed, cand, rk FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(fused, 9) DESC, cand) AS rk FROM biased) t WHERE rk <= 5)", *_after("five")], "again", 3, 1, _end)
_plain, _again = "off AS (SELECT seed, cand FROM ranked WHERE rk <= 4)", "turned AS (" + " UNION ALL ".join(f"SELECT seed, cand FROM p{t}" for t in range(1, 5)) + ")"
_mm = _mmr([*FUSED, "rel AS (SELECT seed, cand, fused AS rel FROM fused)"], SEM_SIM, 4, 0.95, True)
_mm_ctes = _mm[len("WITH ") + len(BOOKS) + 2 : _mm.index(" SELECT seed, 1 AS rank")]
_mean = lambda on, t: f"SELECT {on} AS mmr, round(avg(ge), 6) AS genre, round(avg(ye), 6) AS yearflag, round(0.8 * avg(ge) + 0.2 * avg(ye), 6) AS score FROM (SELECT seed, avg(genre) AS ge, avg({ERA}) AS ye FROM ({genre_hits(t)}) h JOIN num a ON a.book_id = seed JOIN num b ON b.book_id = cand GROUP BY seed) x"
SQL["mmr_on_off"] = sql(_mm_ctes, *GENRE, _plain, _again, select=f"{_mean('false', 'off')} UNION ALL {_mean('true', 'turned')}")
_div = SQL["diversity_hhi"]
SQL["diversity_messages"] = f"SELECT round(h, 6) AS hhi, y AS year_range, CASE WHEN h > 0.5 THEN 'dominated by few' ELSE 'diverse' END AS authors, CASE WHEN y < 5 THEN 'narrow' ELSE 'wide' END AS years FROM (SELECT quantile_cont(hhi, 0.5) AS h, quantile_cont(year_range, 0.5) AS y FROM ({_div}) d) t"
