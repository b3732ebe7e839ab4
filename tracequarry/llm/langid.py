"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased UTF-8 text, hashed to buckets. A text's
vector is the mean of its subwords' embeddings; embeddings and softmax are trained together by
stochastic gradient descent in numpy. A temperature fitted on held-back rows calibrates the
probability, below which a prediction can be rejected.

Training rows are bounded: of the LANGUAGES most frequent languages those doc_ids whose hash is in the
share that gives about PER_LANGUAGE documents a language and about SAMPLE_BYTES in all, and only texts of
at most LEARNED_BYTES bytes.
Every text is scored whole, in slices of bounded bytes, so very long texts need no more memory than
themselves. Defined results: null texts and texts without a letter (Unicode category L) are `und` with
score 0; rows that repeat a doc_id are scored each, and the least of their texts in a language is
learned from; languages of equal frequency go by name, equal probabilities by the languages' order; an
empty table gives an empty result, and without training rows everything is `und`; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sliced

PER_LANGUAGE, LANGUAGES, LEARNED_BYTES, SAMPLE_BYTES = 1000, 500, 100_000, 64_000_000
#: Calibrated probability under which the report calls a prediction rejected.
REJECTED = 0.5
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIMENSION = 16
EPOCHS = 3
RATE = 0.5
SEED = 11
NONE = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAYBE_LETTER.finditer(text))


def subwords(text: str) -> list[np.ndarray]:
    """Bucket numbers of the byte n-grams, an array for each order."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = (two[:-1] << 8 | b[2:]) if len(b) > 2 else two[:0]
    four = (three[:-1] << 8 | b[3:]) if len(b) > 3 else two[:0]
    return [two, three * np.uint32(2654435761) >> 16, four * np.uint32(2246822519) >> 16]


class Model:
    """Labels, for each label a table of logits by order and bucket, the bias and the temperature."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.table, self.bias, self.temperature = labels, table, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        grams = subwords(text)
        total = np.array([sum(float(own[k].take(g).sum(dtype=np.float64)) for k, g in enumerate(grams)) for own in self.table])
        return total / max(sum(map(len, grams)), 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not has_letter(text):
            return NONE, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's subwords, numbered over all orders, and their shares."""
    grams = np.concatenate([g.astype(np.int64) + k * BUCKETS for k, g in enumerate(subwords(text))])
    ids, counts = np.unique(grams, return_counts=True)
    return ids, (counts / max(counts.sum(), 1)).astype(np.float32)


def descend(sparse: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n: int, used: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, softmax weights, bias) after EPOCHS passes of stochastic gradient descent over the used bags."""
    embed = rng.normal(0, 0.1, (len(ORDERS) * BUCKETS, DIMENSION)).astype(np.float32)
    out = np.zeros((DIMENSION, n), np.float32)
    bias = np.zeros(n, np.float32)
    steps, at = EPOCHS * max(1, len(used)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            ids, w = sparse[i]
            rate, at = RATE * (1 - at / steps), at + 1
            h = w @ embed[ids]
            g = softmax(h @ out + bias)
            g[target[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            embed[ids] -= (rate * 50) * np.outer(w, back)
    return embed, out, bias


def train(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((0, len(ORDERS), BUCKETS), np.float32), np.zeros(0), 1.0)
    target = np.array([labels.index(x) for x in langs])
    sparse = [bag(t) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed, out, bias = descend(sparse, target, len(labels), used, rng)
    table = (embed @ out).reshape(len(ORDERS), BUCKETS, len(labels))  # a mean of embeddings times out is the mean of these rows
    raw = np.array([sparse[i][1] @ table.reshape(-1, len(labels))[sparse[i][0]] + bias for i in held]).reshape(-1, len(labels))
    temperature = 1.0
    if len(held):
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(held)), target[held]] + 1e-9).mean()
        temperature = min((float(t) for t in np.geomspace(0.02, 5, 40)), key=loss)
    return Model(labels, np.ascontiguousarray(table.transpose(2, 0, 1)), bias.astype(np.float64), temperature)


def training_rows(docs: DataFrame, usable, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, lang, text) of about per_language documents a language, all where there are no more, and of about
    most_bytes in all, chosen by hash of doc_id before any text moves. A language's documents and bytes are only counted:
    repeated rows are one document."""
    rows = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= LEARNED_BYTES))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"), F.avg(F.octet_length("text")).alias("size"))
    counts = counted.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    shares = {lang: min(1.0, 1.1 * per_language / n) for lang, n, _ in counts}  # the count may be some hundredths too large
    scale = min(1.0, most_bytes / max(1.0, sum(shares[lang] * n * size for lang, n, size in counts)))
    within = F.lit(False)
    for lang, share in shares.items():
        last = min(2**63 - 1, int(share * scale * 2**64) - 2**63)
        within = within | ((F.col("lang") == lang) & (F.xxhash64("doc_id") <= F.lit(last).cast("long")))
    return rows.where(within).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # repeated rows collapse before they move


def fit(docs: DataFrame, usable, per_language: int = PER_LANGUAGE) -> Model:
    rows = sorted(map(tuple, training_rows(docs, usable, per_language).collect()))
    return train([r[2] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, model: Model, reject_below: float = 0.0) -> DataFrame:
    """(doc_id, lang_pred, score): und where the calibrated score is under reject_below."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature))  # of fixed size for each label

    def score(batches):
        m = Model(*shared.value)
        for b in sliced(batches, 1):
            found = [m.predict(t.as_py()) for t in b.column(1)]
            lang = [x if s >= reject_below else NONE for x, s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """A row per document; learned only from rows whose crc32 of doc_id mod 4 is not 2. und is only for
    texts without a letter; predictions under REJECTED are told apart in rejected."""
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, ~held)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", (F.col("score") < REJECTED).alias("rejected"))
