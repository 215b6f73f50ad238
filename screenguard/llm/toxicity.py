"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon isn't given: it is learnt from labelled documents, as words and word
beginnings that toxic documents hold far more often than others. Features are its
densities, how near its words stand to the second person, and rates of capitals,
punctuation and obfuscation. Labelled documents are scored by lexicons that did not see
them, so the trees learn from densities as they are in new documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, sliced
from .simhash import shingle_hashes

#: Labelled documents of each class that the sample has on average at most; the bound of the fit.
TOXIC_ROWS, OTHER_ROWS = 6_000, 8_000
FOLDS = 3
#: Parts of the sample: each is scored by trees that the others trained, and those scores calibrate.
PARTS = 4
BEGINNINGS = (3, 4, 5, 6, 7)
#: Share of toxic documents, at equal classes, that an entry of each tier has at least.
TIERS = (0.95, 0.8)
#: Log likelihood ratio of an entry's counts against chance, at least; a million tokens are tried.
SURE, STRONG = 13.0, 20.0
#: Words of the second person in the languages at hand (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
#: Characters that stand for letters in obfuscated words (fixed values).
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
NEAR = 5
#: Distinct tokens whose analysis a worker keeps.
KEPT_TOKENS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(r"[^\W\d_][\d@$!|*.\-_#]+[^\W\d_]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("strong", "weak", "strong count", "weak count", "hidden", "near you", "you", "capitals", "shouted", "punctuation", "bangs", "broken", "repeated", "log words")


@dataclass
class Lexicon:
    words: dict[str, int]  # tier by word
    starts: dict[str, int]  # tier by beginning

    def tier(self, word: str) -> int:
        """0 for none, else 1 for strong, 2 for weak."""
        found = [t for n in BEGINNINGS if len(word) > n and (t := self.starts.get(word[:n]))]
        if t := self.words.get(word):
            found.append(t)
        return min(found, default=0)


def lexicon(counts: Iterable[tuple[str, int, int]], toxic: float, other: float) -> Lexicon:
    """counts: (token, toxic documents, other documents); a token ``a*`` is a beginning."""
    scored = []
    for token, a, b in counts:
        p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (other + 1)
        purity = p / (p + q)
        if a < 4 or purity < TIERS[-1]:
            continue
        share = toxic / (toxic + other)
        chance = a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0)
        if chance >= SURE:
            scored.append((-chance, token, 1 if purity >= TIERS[0] and chance >= STRONG else 2, a))
    scored.sort()
    longer: dict[str, int] = {}  # of a beginning: the most documents that a longer entry explains
    for _, t, _, a in scored:
        for n in BEGINNINGS:
            if n < len(t.rstrip("*")):
                longer[t[:n]] = max(longer.get(t[:n], 0), a)
    keep = [x for x in scored if x[1][-1] != "*" or longer.get(x[1][:-1], 0) < 0.9 * x[3]]
    return Lexicon({t: k for _, t, k, _ in keep if t[-1] != "*"}, {t[:-1]: k for _, t, k, _ in keep if t[-1] == "*"})


def tokens_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def likeness_keys(text: str, keys: int = 3) -> list[int]:
    """The least of each of some hashes of the text's five-word shingles: near copies share most of them."""
    h = shingle_hashes(text, 5)
    with np.errstate(over="ignore"):
        return [int((h * np.uint64(2 * k * 0x9E3779B97F4A7C15 % (1 << 64) + 1)).min() >> np.uint64(1)) if len(h) else 0 for k in range(keys)]


def later_copies(ids: list, y: np.ndarray, keys: list[list[int]]) -> list:
    """Ids of rows that share most of their keys with one row of the same class and a smaller id."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    held: dict[tuple, list[int]] = {}  # rows that stay, by key
    out = []
    for i in order:
        own = [(int(y[i]), k, x) for k, x in enumerate(keys[i])]
        same = Counter(j for key in own for j in held.get(key, ()))
        if any(2 * n > len(own) for n in same.values()):
            out.append(ids[i])
        else:
            for key in own:
                held.setdefault(key, []).append(i)
    return out


class Analyser:
    """Features of whole texts; analyses of tokens are kept, as a bounded table."""

    def __init__(self, lex: Lexicon):
        self.lex, self.place, self.table = lex, {}, np.zeros((1024, 11), np.float32)

    def _token(self, token: str) -> tuple:
        low = token.lower()
        repeated = bool(_REPEATED.search(low))
        if low == token and token.isalpha():
            tier = self.lex.tier(low)
            return (tier == 1, tier == 2, repeated and not tier and self._hidden(low), low in SECOND_PERSON, len(low), 0, 0, 0, 0, 0, repeated)
        words = _WORD.findall(low)
        tiers = [self.lex.tier(w) for w in words]
        letters = sum(map(len, words))
        upper = 0 if low == token else sum(map(str.isupper, token))
        broken = letters < len(token) and bool(_BROKEN.search(low))
        hidden = (broken or repeated) and not any(tiers) and self._hidden(low)
        return (tiers.count(1), tiers.count(2), hidden, not SECOND_PERSON.isdisjoint(words), letters, upper, letters > 2 and upper == letters, len(token) - letters, token.count("!") + token.count("?"), broken, repeated)

    def _hidden(self, low: str) -> bool:
        """Whether the word is a strong one once look-alikes, signs and repeats are undone."""
        plain = re.sub(r"[^\w]|_", "", low.translate(LOOKALIKE))
        return any(self.lex.tier(w) == 1 for w in (plain, re.sub(r"(.)\1+", r"\1", plain)))

    def _places(self, tokens: list[str]) -> np.ndarray:
        if len(self.place) > KEPT_TOKENS:
            self.place, self.table = {}, np.zeros((1024, 11), np.float32)
        place = self.place
        new = list(set(tokens).difference(place))
        if new:
            at = len(place)
            if at + len(new) > len(self.table):
                more = np.zeros((max(len(self.table), len(new)), 11), np.float32)
                self.table = np.concatenate([self.table, more])
            self.table[at : at + len(new)] = [self._token(t) for t in new]
            place.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))

    def features(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(len(FEATURES))
        places = self._places(tokens)
        each = self.table[places]
        s, n = each.sum(0, dtype=np.float64), len(tokens)
        near = 0
        if (s[0] or s[2]) and s[3]:
            hit, you = np.flatnonzero(each[:, 0] + each[:, 2]), np.flatnonzero(each[:, 3])
            i = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - hit), np.abs(you[np.maximum(i - 1, 0)] - hit))
            near = (gap <= NEAR).mean()
        letters = max(1.0, s[4])
        return np.array([s[0] / n, s[1] / n, min(s[0], 20), min(s[1], 20), s[2] / n, near, s[3] / n, s[5] / letters, s[6] / n, s[7] / n, s[8] / n, s[9] / n, s[10] / n, np.log1p(n)])


# ---- trees and calibration ------------------------------------------------------------


class Boosted:
    """Logistic boosting of depth-limited trees over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.model: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c[c != c.min()] if (c != c.min()).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        b = np.stack([np.searchsorted(k, c, side="right") for k, c in zip(self.cuts, x.T, strict=True)], 1)
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree, width = np.zeros(len(y), np.int64), [], self.bins + 1
            for level in range(self.depth):
                n = 1 << level
                best = (np.full(n, 1e-9), np.zeros(n, np.int64), np.full(n, self.bins + 1))
                for j in range(x.shape[1]):
                    key = node * width + b[:, j]
                    gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                    ga, ha = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.ridge) + ga**2 / (ha + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    gain[(hs < 1e-3) | (ha < 1e-3)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(n), at] > best[0]
                    best[0][better], best[1][better], best[2][better] = gain[np.arange(n), at][better], j, at[better]
                tree.append((best[1], best[2]))
                node = node * 2 + (b[np.arange(len(y)), best[1][node]] > best[2][node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            tree.append(leaf)
            self.model.append(tree)
            f += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(k, c, side="right") for k, c in zip(self.cuts, x.T, strict=True)], 1)
        f = np.full(len(x), self.base)
        for *levels, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for j, at in levels:
                node = node * 2 + (b[np.arange(len(x)), j[node]] > at[node])
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, value) of the weighted non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]
    at = np.array([v for p in pools for v in p[:2]])
    return at, np.array([p[2] / p[3] for p in pools for _ in range(2)])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        # a hundredth of the uncalibrated score keeps the order inside a step
        return 0.99 * np.interp(raw, *self.steps) + 0.01 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> ToxicityModel | None:
    """Train on labelled documents whose id satisfies ``learn`` (over the column ``id``); None without both classes.

    Each class is sampled by a hash of the id, at a rate that gives the stated rows on
    average, or taken whole if it has fewer. Only the sample's ids are broadcast; the
    driver gets, of the sample, three keys and a row of features a document, and counts of the
    tokens that at least four toxic documents hold. A document with labels that differ counts
    as toxic. Of near copies of one class in the sample (two of three min-hashes equal) only
    the one of the smallest id is learnt from. Null texts, and null ids, aren't learnt from;
    repeated rows of one id are learnt from as often; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")).where(learn)
    size = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(size) < 2:
        return None
    rate = {1: min(1.0, toxic_rows / size[1]), 0: min(1.0, other_rows / size[0])}
    near = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 20)) < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]) * (1 << 20)
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int")
    marks = marks.where(near).withColumn("fold", fold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(marks), "id").select("id", "text", "y", "fold").checkpoint()
    kind = rows.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            yield pa.record_batch([b.column(0), b.column(2), pa.array([likeness_keys(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "y", "k"])

    # of copies and near copies one stays: else the words of a copied text look like a lexicon
    keys = rows.mapInArrow(keyed, f"id {kind}, y int, k array<long>").toArrow()
    copies = later_copies(keys["id"].to_pylist(), keys["y"].to_numpy(), keys["k"].to_pylist())
    if copies:
        rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in copies], f"id {kind}")), "id", "left_anti").checkpoint()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(sums)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.int64())], ["token", "class", "n"])

        for b in sliced(batches, "text"):
            for text, y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                c = 2 * f + y
                sums.update((t, c) for t in tokens_of(text))
            if len(sums) > 1_000_000:
                yield out()
                sums.clear()
        yield out()

    counts = rows.mapInArrow(count, "token string, class int, n long").groupBy("token").agg(*[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)])
    toxic, other = F.expr("+".join(f"c{2 * f + 1}" for f in range(FOLDS))), F.expr("+".join(f"c{2 * f}" for f in range(FOLDS)))
    totals = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    all_toxic, all_other = (sum(totals.get((f, y), 0) for f in range(FOLDS)) for y in (1, 0))
    if not all_toxic or not all_other:
        return None
    odds = (toxic / all_toxic) / (toxic / all_toxic + other / all_other)
    picked = counts.where((toxic >= 4) & (odds >= TIERS[-1] - 0.1)).toArrow().sort_by("token")
    tokens = picked["token"].to_pylist()
    seen = np.stack([picked[f"c{c}"].to_numpy() for c in range(2 * FOLDS)])

    def without(fold: int | None) -> Lexicon:
        folds = [f for f in range(FOLDS) if f != fold]
        n = [sum(totals.get((f, y), 0) for f in folds) for y in (1, 0)]
        a, b = (sum(seen[2 * f + y] for f in folds) for y in (1, 0))
        return lexicon(zip(tokens, a.tolist(), b.tolist(), strict=True), *n)

    lex = [without(f) for f in range(FOLDS)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [Analyser(x) for x in lex]
        for b in sliced(batches, "text"):
            x = [each[f].features(t) for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.mapInArrow(features, f"id {kind}, y int, x array<double>").toArrow().sort_by("id")
    x, y = np.array(got["x"].to_pylist()), np.array(got["y"].to_pylist(), float)
    # every row is calibrated with by a score of trees that didn't see it, at any size
    part, raw = np.random.default_rng(11).permutation(len(y)) % PARTS, np.zeros(len(y))
    for k in range(PARTS):
        if (part == k).any():
            raw[part == k] = Boosted().fit(x[part != k], y[part != k]).raw(x[part == k]) if (part != k).any() else 0.0
    trees = Boosted().fit(x, y)
    weight = np.where(y > 0, 1 / rate[1], 1 / rate[0])
    whole = without(None)
    del got, picked
    release()
    return ToxicityModel(whole, trees, isotonic(raw, y, weight))


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), a row for each row of ``docs``, from whole texts.

    Null and empty texts have all features 0 and are scored like any other; without a model
    every score is 0. Repeated rows and null ids are kept; other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(model.lexicon) if model else None
        for b in sliced(batches, "text"):
            s = model.score(np.stack([analyser.features(t) for t in b.column(1).to_pylist()])) if model else np.zeros(b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic; all rows without a model.

    Null and empty texts are scored like any other; repeated rows share their verdict; ids
    aren't looked at; no rows give no rows.
    """
    prepare(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(model.lexicon)
        for b in sliced(batches, text_col):
            yield b.filter(pa.array(model.score(np.stack([analyser.features(t) for t in b.column(place).to_pylist()])) < 0.5))

    return docs.mapInArrow(run, docs.schema) if model else docs
