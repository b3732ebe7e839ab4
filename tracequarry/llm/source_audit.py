"""Source divergence audit: how far the sources of a language differ in their words, and by which.

A first pass over the texts adds, in each task, a document's distinct terms to a count-min sketch of
the document frequencies of (language, term). Counts stop at LEAST, which is all that is asked for, so the tasks' sketches
travel as bytes, by block, and are added up by block; what is left of the merged sketch is one bit for each
counter: whether it reached LEAST. A term of LEAST documents has all its bits, as a sketch never underestimates. The second pass drops every
term that lacks a bit before anything is shuffled, and counts what is left exactly, by string: occurrences and documents for each
language, source and term. Terms that the sketch let through in error fall by their exact count.

The divergences of two sources are summed over the terms that they hold: terms that only one of them
holds by that source's counts (f depends on the count alone, so a histogram of counts is enough), terms that both hold
by a join on (language, term), and the rest by one product. All arithmetic is of integers.

Terms meet by 64-bit hash inside a slice of a task and by string everywhere else. Defined results: null text, language and source
are ''; every row counts as a document, whatever its doc_id; a group of texts without terms has its pairs and no
terms; a language without kept terms has pairs of value 0; a language of one source has no pairs; equal values rank by
item in order of UTF-8 bytes; very long texts are read whole; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sliced
from .packed import Hasher, mix

#: Documents of its language that hold a kept term, terms listed for a group, and what p is scaled by.
LEAST, TERMS, SCALE = 10, 10, 1_000_000_000
#: Rows of the sketch; counters of a row, one for so many bytes of text between two powers of two; counters of a block.
DEPTH, BYTES_A_COUNTER, NARROWEST, WIDEST, BLOCK = 4, 512, 1 << 16, 1 << 24, 1 << 18
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sketch_width(text_bytes: int) -> int:
    """Counters of a row of the sketch; bounded, as its bits go to every task."""
    width = NARROWEST
    while width < WIDEST and width * BYTES_A_COUNTER < text_bytes:
        width *= 2
    return width


class Terms:
    """The terms of a slice of (lang, source, text)."""

    def __init__(self, batch: pa.RecordBatch):
        self.lang, self.source, texts = (pc.fill_null(pc.cast(c, pa.binary()), b"").to_pylist() for c in batch.columns)
        hasher = Hasher(fold_case=True)
        hasher.solid = _LETTERS
        self.hashes, counts = hasher.words(texts)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTERS[self.raw]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]

    def keyed(self) -> np.ndarray:
        """The hash of each term's language and string."""
        names, at = _ids(self.lang)
        salts = np.array([int.from_bytes(hashlib.blake2b(n, digest_size=8).digest(), "little") for n in names], np.uint64)
        return mix(self.hashes ^ salts[at[self.doc]])

    def strings(self, at: np.ndarray) -> pa.Array:
        size = self.ends[at] - self.starts[at]
        bounds = np.concatenate([[0], size.cumsum()])
        place = np.arange(bounds[-1]) + np.repeat(self.starts[at] - bounds[:-1], size)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(_LOWER[self.raw[place]].tobytes())])


def _ids(values: list) -> tuple[list, np.ndarray]:
    """(distinct values, which one each value is)."""
    places: dict = {}
    at = np.array([places.setdefault(v, len(places)) for v in values], np.int64)
    return list(places), at


def _runs(key: np.ndarray) -> np.ndarray:
    """Whether each place of a sorted array starts a run of equal values."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new


def counters(term: np.ndarray, width: int):
    """The counter of each term in each row of the sketch."""
    step = mix(term) | np.uint64(1)
    for k in range(DEPTH):
        yield (((term + np.uint64(k) * step) >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)


def sketch_bits(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """The merged sketch of document frequencies: for each row one bit for each counter, whether it reached least."""
    block = min(BLOCK, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((DEPTH, width), np.uint8)
        for b in sliced(batches, 2):
            t = Terms(b)
            key = t.keyed()
            by = np.argsort(key, kind="stable")  # documents stay in order
            new = _runs(key[by]) | _runs(t.doc[by])
            for k, c in enumerate(counters(key[by][new], width)):
                c, n = np.unique(c, return_counts=True)
                sums[k, c] = np.minimum(sums[k, c] + np.minimum(n, least), least)
        for k in range(DEPTH):
            for s in range(0, width, block):
                if (own := sums[k, s : s + block]).any():
                    yield pa.RecordBatch.from_pydict({"at": pa.array([(k * width + s) // block], pa.int32()), "counts": pa.array([own.tobytes()], pa.binary())})

    def added(at: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(block, np.uint8)
        for b in batches:
            for x in b.column("counts"):
                sums = np.minimum(sums + np.frombuffer(x.as_py(), np.uint8), least).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(sums >= least).tobytes()], pa.binary())})

    bits = np.zeros((DEPTH * width // block, block // 8), np.uint8)
    for r in texts.mapInArrow(partial, "at int, counts binary").groupBy("at").applyInArrow(added, "at int, bits binary").collect():
        bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(DEPTH, width // 8)


def may_reach(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the sketch has a bit for the term in every row; never false for a term that is held by enough documents."""
    ok = np.ones(len(key), bool)
    for row, c in zip(bits, counters(key, bits.shape[1] * 8)):
        ok &= (row[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return ok


def term_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that at least least documents of their language hold, n and lang_n
    being their occurrences in the source and in the language. texts has lang, source and text."""
    spark = texts.sparkSession
    width = sketch_width(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = spark.sparkContext.broadcast(sketch_bits(texts, width, least))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            t = Terms(b)
            own = np.flatnonzero(may_reach(t.keyed(), bits.value))
            groups, group = _ids(list(zip(t.lang, t.source)))
            key = mix(t.hashes[own] + group[t.doc[own]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            by = np.argsort(key, kind="stable")  # documents stay in order
            new, own = _runs(key[by]), own[by]
            first = np.flatnonzero(new)
            if not len(first):
                continue
            docs = np.add.reduceat((new | _runs(t.doc[own])).astype(np.int64), first)
            own = own[first]
            names = [pa.array([g[k].decode("utf-8", "replace") for g in groups], pa.string()).take(pa.array(group[t.doc[own]])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, t.strings(own), pa.array(np.diff(np.append(first, len(new)))), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    counts = texts.mapInArrow(counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    whole = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    return whole.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")


def _p(count: str, total: str, terms: str) -> F.Column:
    """p of a count; where its language has terms."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergences(docs: DataFrame, least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has the divergence of every two sources of a language, part
    term the terms that a source uses more than its language, up to rank terms."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    held, _ = saved(term_counts(texts, least))
    of_lang = held.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    of_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = texts.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "own", "v", "lang_total"])
    groups, _ = saved(groups.withColumn("none", F.when(F.col("v") > 0, _p("0", "total", "v"))))

    scored = held.join(groups, ["lang", "source"]).withColumn("p", _p("n", "total", "v"))
    more = scored.withColumn("q", _p("lang_n", "lang_total", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))

    one = groups.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), "v", F.col("none").alias("none_a"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("none").alias("none_b"))
    rest = one.join(other, "lang").where("a < b").select("lang", "a", "b", F.expr(f"coalesce((v - own_a - own_b) * {_f('none_a', 'none_b')}, 0)").alias("value"))
    shapes = scored.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = shapes.join(other, "lang").where("source <> b").select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), F.expr(f"times * {_f('p', 'none_b')}").alias("value"))
    left = scored.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("none").alias("none_a"))
    right = scored.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("none").alias("none_b"))
    shared = f"{_f('p_a', 'p_b')} - {_f('p_a', 'none_b')} - {_f('none_a', 'p_b')} + {_f('none_a', 'none_b')}"
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(shared).alias("value"))
    summed = rest.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = summed.select("lang", "value", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    best_first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = more.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= terms)
    return pairs.withColumn("rank", F.row_number().over(best_first)).unionByName(top)
