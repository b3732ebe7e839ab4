"""Packed exchanges: hashes travel between batches of documents and hash partitions as sorted arrays.

Documents are dealt into batches by hash of doc_id, each of bounded size. A batch sends the hashes
that it holds to partitions of the hash space, packed in one binary for each partition; a partition
answers each batch with the hashes of interest. A hash is sent once for each batch, however many of the batch's
documents hold it, so a passage or shingle that a third of all documents share stays small.

Rows of an exchange are batches times partitions at most. From STEADY_BYTES of text on both sizes grow
with the square root of the input, so that the rows grow with the input itself, up to LARGEST times,
where a task needs about 1.5 GB; beyond that the rows of a batch get shorter, and are never more than its
hashes. Sizes change no result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Bytes of text aimed at in a batch, and in a partition of the hash space.
BATCH_BYTES = 4_000_000
PART_BYTES = 60_000_000
#: From here on both grow with the square root of the text's bytes, up to so many times.
STEADY_BYTES, LARGEST = 30_000_000_000, 16
_MASK = np.uint64(0xFFFFFFFF)
_RNG = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def sizes(total: int, least: int, batch_bytes: int = BATCH_BYTES) -> tuple[int, int]:
    """Numbers of batches and of hash partitions for so many bytes of text; least is the least number of tasks."""
    grown = min(float(LARGEST), math.sqrt(max(1.0, total / STEADY_BYTES)))
    return max(3 * least, int(total / (batch_bytes * grown))), max(least, int(total / (PART_BYTES * grown)))


def plan(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(docs as doc_id, text, batch; number of batches; number of hash partitions)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_parts = sizes(total, partitions(docs.sparkSession))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch")
    return docs.select("doc_id", "text", batch), n_batches, n_parts


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class Hasher:
    """Hashes of words and of runs of words. Words are runs of bytes other than ASCII white space."""

    def __init__(self, fold_case: bool):
        rng = np.random.default_rng(7)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        if fold_case:
            self.values[65:91] = self.values[97:123]
        self.solid = np.ones(256, bool)
        self.solid[[9, 10, 11, 12, 13, 32]] = False
        self.up, self.down = _powers(_BASE, 0), _powers(_INVERSE, 0)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def words(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word of all texts in order, number of words of each text)."""
        raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        self.grow(len(raw) + 1)
        solid = np.concatenate([[False], self.solid[raw]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        hashed = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(d) + 1 for d in data])
        counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
        return hashed, counts

    def runs(self, words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; runs that reach beyond the end are left out."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self.grow(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * self.down[:n] + np.uint64((k * 0x632BE5AB + salt * 0x9E3779B1) & 0xFFFFFFFF))


def chunks(texts: list[str | None], size: int = 1_000_000):
    """(first, last + 1, encoded texts) of consecutive texts of about size bytes together."""
    at, held, data = 0, 0, []
    for k, t in enumerate(texts):
        data.append((t or "").encode("utf-8", "replace"))
        held += len(data[-1])
        if held >= size:
            yield at, k + 1, data
            at, held, data = k + 1, 0, []
    if data:
        yield at, len(texts), data


def part_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(n_parts)


def low(h: np.ndarray) -> np.ndarray:
    return (h & _MASK).astype(np.uint32)


def split_by_part(h: np.ndarray, n_parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, positions in h) for the parts that occur."""
    part = part_of(h, n_parts).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(p, order[edges[p] : edges[p + 1]]) for p in range(n_parts) if edges[p] < edges[p + 1]]


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x
