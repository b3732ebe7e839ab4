"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a seed lexicon and of a lexicon learned from labelled texts (words
and word beginnings by log odds), proximity of hits to second-person words, rates of capitals,
punctuation and obfuscated words. Trees are boosted on histograms in numpy; scores are calibrated
by pooling adjacent violators on rows kept out of the boosting.

Training rows are bounded: the SAMPLE labelled rows of smallest hash of doc_id, split by hash into
lexicon, boosting and calibration rows. Every text is scored whole, in slices of SLICE_BYTES, so very
long texts need no more memory than themselves. Defined results: null and empty texts have zero
features and are scored like any other; rows that repeat a doc_id are scored each, and the least of
their texts is learned from; repeated label rows count once, contradictory ones both; labels other
than 0 and 1 are no labels; ties in hash are all taken; an empty table gives an empty result, and
without both labels in the sample all scores are 0; the filter keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sliced

SAMPLE = 9000
LEXICON = 500
TREES, LEVELS, BINS, RATE, LEAST_ROWS = 80, 3, 32, 0.15, 20  # leaves of small samples may hold fewer rows
THRESHOLD = 0.7
#: Seed lexicon and second-person words.
SEEDS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown garbage imbecile dumb filth freak jerk hate idiota imbécil estúpido basura asco idioten dumm dreck abschaum trottel crétin imbécile ordure débile connard".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
STARTS = (4, 5, 6, 7)
NEAR = 5
NAMES = ("length", "seed_density", "learned_density", "learned_kinds", "learned_weight", "learned_top", "near_second", "second", "capitals", "punctuation", "shouts", "obfuscated", "stretched")
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*0-9'’._-]+[^\W_]+)*")
_EDGES = ".,;:!?\"'()[]{}<>«»“”„…|#*$%&"
_MIXED = re.compile(r"^(?=.*[^\W\d_])(?=.*[@$!*0-9._]).+$")
_STRETCH = re.compile(r"(.)\1\1")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "_": "", "-": "", "'": "", "’": ""})


class Lexicon(dict):
    """word -> (seed, learned weight, learned entry, second person, obfuscated, stretched), found once for each word while it is kept."""

    KEPT = 100_000

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned, self.seeds, self.second = learned, frozenset(SEEDS), frozenset(SECOND)

    def __missing__(self, word: str):
        if len(self) > self.KEPT:
            self.clear()
        low = word.strip(_EDGES).lower()
        mixed = bool(_MIXED.match(low))
        plain = low.translate(_PLAIN) if mixed else low
        best, entry = 0.0, None
        for key in (f"={plain}", *(plain[:n] for n in STARTS if len(plain) >= n)):
            if (w := self.learned.get(key, 0.0)) > best:
                best, entry = w, key
        found = (plain in self.seeds, best, entry, low in self.second, mixed, bool(_STRETCH.search(low)))
        self[word] = found if any(found) else None
        return self[word]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    tokens = text.split()
    n, chars = max(len(tokens), 1), max(len(text), 1)
    marked = [(i, x) for i, x in enumerate(map(lexicon.__getitem__, tokens)) if x is not None]
    hits = [(i, x) for i, x in marked if x[0] or x[1] > 0]
    you = [i for i, x in marked if x[3]]
    near, at = 0, 0
    for i, _ in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        near += at < len(you) and you[at] <= i + NEAR
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = _CLASS @ np.bincount(raw, minlength=256)
    weights = [x[1] for _, x in hits]
    return [
        math.log1p(len(tokens)), sum(x[0] for _, x in hits) / n, sum(x[1] > 0 for _, x in hits) / n, float(len({x[2] for _, x in hits if x[2]})),
        sum(weights) / math.sqrt(n), max(weights, default=0.0), near / n, len(you) / n, float(kinds[0]) / chars, float(kinds[1]) / chars,
        float(kinds[2]) / chars, sum(x[4] for _, x in marked) / n, sum(x[5] for _, x in marked) / n,
    ]


#: Rows of a byte: capital, punctuation, exclamation or question mark.
_CLASS = np.zeros((3, 256), np.int64)
_CLASS[0, 65:91] = 1
_CLASS[1, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[2, [33, 63]] = 1


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """(prior, trees); a tree is (features, cuts, leaf values) of a full binary tree, level by level."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    least = max(3, min(LEAST_ROWS, len(y) // 100))
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    f, trees = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feats, cuts = [], []
        for level in range(LEVELS):
            for k in range(1 << level):
                own = np.flatnonzero(node == k)
                best = (1e-9, 0, math.inf, BINS)
                for j, e in enumerate(edges):
                    if len(e) == 0 or len(own) < 2 * least:
                        continue
                    gs, hs, ns = (np.bincount(binned[own, j], w, len(e) + 1).cumsum() for w in (g[own], h[own], None))
                    left = slice(0, len(e))
                    gain = gs[left] ** 2 / (hs[left] + 1) + (gs[-1] - gs[left]) ** 2 / (hs[-1] - hs[left] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    gain[(ns[left] < least) | (ns[-1] - ns[left] < least)] = -1
                    if gain.max() > best[0]:
                        c = int(gain.argmax())
                        best = (float(gain[c]), j, float(e[c]), c)
                feats.append(best[1])
                cuts.append(best[2])
            at = (1 << level) - 1
            fj, ck = np.array(feats[at:])[node], np.array(cuts[at:])[node]
            node = 2 * node + (x[np.arange(len(y)), fj] > ck)
        leaves = RATE * np.bincount(node, g, 1 << LEVELS) / (np.bincount(node, h, 1 << LEVELS) + 1)
        f += leaves[node]
        trees.append((np.array(feats), np.array(cuts), leaves))
    return prior, trees


def raw_scores(x: np.ndarray, prior: float, trees: list) -> np.ndarray:
    f, rows = np.full(len(x), prior), np.arange(len(x))
    for feats, cuts, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for level in range(LEVELS):
            k = node + (1 << level) - 1
            node = 2 * node + (x[rows, feats[k]] > cuts[k])
        f += leaves[node]
    return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration by pooling adjacent violators, with a pseudo-count of one row over all."""
    order = np.argsort(f, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, lowest and highest raw score
    for s, t in zip(f[order], y[order]):
        pools.append([float(t), 1.0, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2], hi]
    base = float(y.mean()) if len(y) else 0.0
    xs, ys = [], []
    for a, n, lo, hi in pools:
        xs += [lo, hi]
        ys += [(a + 0.5 * base) / (n + 0.5)] * 2
    return np.array(xs), np.maximum.accumulate(np.array(ys)) if ys else np.array(ys)


class Model:
    def __init__(self, learned: dict[str, float], prior: float, trees: list, knots: tuple[np.ndarray, np.ndarray]):
        self.learned, self.prior, self.trees, self.knots = learned, prior, trees, knots

    def parts(self) -> tuple:
        """Plain data of bounded size: at most LEXICON entries and TREES trees."""
        return self.learned, self.prior, self.trees, self.knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]) or not len(x):
            return np.zeros(len(x))
        return np.clip(np.interp(raw_scores(x, self.prior, self.trees), *self.knots), 0, 1)


def sample_rows(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> DataFrame:
    """(part, toxic, text) of at most sample labelled rows (and ties in hash): part 0-4 lexicon, 5-7 boosting, 8-9 calibration."""
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    rows = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).distinct()
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last if last is not None else -(2**63)).cast("long"))  # bounded by sample: may be broadcast
    part = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(10)).cast("int")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated rows collapse before they move
    return once.select(part.alias("part"), "toxic", "text")


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Words (=word) and word beginnings that are far likelier in toxic texts, with their log odds."""

    def count(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = {w.lower() for w in _TOKEN.findall(text)}
                for key in {f"={w}" for w in low} | {w[:n] for w in low for n in STARTS if len(w) >= n}:
                    counts.setdefault(key, [0, 0])[toxic] += 1
            keys = [*counts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][j] for k in keys], pa.int64()) for j in (1, 0))], ["key", "bad", "good"])

    of = rows.select("toxic", "text")
    n = {int(t): c for t, c in of.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}
    sums = of.mapInArrow(count, "key string, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log(((F.col("bad") + 0.5) / (n[1] + 1)) / ((F.col("good") + 0.5) / (n[0] + 1)))
    best = sums.where(F.col("bad") >= 4).withColumn("w", weight).where(F.col("w") >= 2.0)
    return {r["key"]: float(r["w"]) for r in best.orderBy((F.col("bad") * F.col("w")).desc(), "key").limit(size).collect()}


def fit(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> Model:
    rows = sample_rows(docs, labels, usable, sample)
    learned = learn_lexicon(rows.where("part < 5"))

    def measure(batches):
        lexicon = Lexicon(learned)
        for b in batches:
            x = [features(t, lexicon) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["part", "toxic", "x"])

    got = rows.where("part >= 5").mapInArrow(measure, "part int, toxic int, x array<double>").collect()
    got = sorted((r["part"], r["toxic"], r["x"]) for r in got)
    take = lambda f: (np.array([x for p, _, x in got if f(p)], float).reshape(-1, len(NAMES)), np.array([t for p, t, _ in got if f(p)], float))
    (x, y), (cx, cy) = take(lambda p: p < 8), take(lambda p: p >= 8)
    if not 0 < y.sum() < len(y) or not 0 < cy.sum() < len(cy):
        return Model(learned, 0.0, [], (np.zeros(0), np.zeros(0)))
    prior, trees = boost(x, y)
    return Model(learned, prior, trees, isotonic(raw_scores(cx, prior, trees), cy))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        m = Model(*shared.value)
        lexicon = Lexicon(m.learned)
        for b in sliced(batches, 1):
            x = np.array([features(t.as_py(), lexicon) for t in b.column(1)], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(x), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document; learned only from rows whose crc32 of doc_id mod 3 is not 1."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    scored = score(docs, fit(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those scored at THRESHOLD or more, with docs' columns."""
    model = fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        lexicon = Lexicon(m.learned)
        for b in sliced(batches, at):
            x = np.array([features(t.as_py(), lexicon) for t in b.column(at)], float).reshape(-1, len(NAMES))
            yield b.filter(pa.array(m.scores(x) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
