"""Benchmark decontamination with a BM25 inverted index of the test items and block-max WAND.

Every document is cut into passages of two segments each, overlapping by one; a segment is as long
as the longest item, so an item inside a document is whole in some passage. Each passage is a query
against the index: impacts are BM25 term scores as a share of the item's score against itself, and
all items at THRESHOLD or more are retrieved. The upper bounds of all passages of a batch are summed
from block maxima at once; passages that may reach the threshold run block-max WAND. A retrieved
item is verified by the overlap of its question (word shingles) and of its answer (the longest run
of its words), its answer being its last sentence.

The index is built from at most INDEX_CHARS characters of items and sent to all tasks; a larger
benchmark is dealt in shards that are each probed by all documents, with the number of items, document
frequencies, mean and longest length of the whole benchmark, so that shards change no score. Defined
results: null and blank documents and items match nothing; very long documents are many passages, taken
in slices of bounded bytes; an item is an item_id with its text: repeated rows count once, texts that
share an item_id or have none are items each; of an item's passages the one of the best score and then
overlaps is told; items of equal score are all told; rows that repeat a doc_id are looked up each; an
empty table on either side matches nothing; extra columns of the documents, whatever their names, pass
through the filter, those of the benchmark are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK = 4
SHINGLE = 5
QUESTION, ANSWER = 0.5, 0.6
INDEX_CHARS = 8_000_000
#: Sums of blocks, and summands, held at once: about 100 MB.
WORK = 4_000_000
#: ASCII other than letters and digits goes to a space.
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words before its last sentence, and those of it; a quarter is the answer where that leaves no question."""
    pieces = [w for w in (terms(s) for s in text.replace("?", ".").replace("!", ".").split(".")) if w]
    whole = [w for p in pieces for w in p]
    last = len(pieces[-1]) if pieces else 0
    if last < 2 or 2 * last > len(whole):
        last = max(1, len(whole) // 4)
    return whole[: len(whole) - last], whole[len(whole) - last :]


class Index:
    """Postings by term: items in order with their impacts, and blocks of items with their largest impact.

    whole: (number of items, sum of their lengths, longest length, document frequencies of these items' terms)
    of a benchmark that the items are a shard of.
    """

    def __init__(self, items: list[tuple[int | None, str]], whole: tuple[int, int, int, dict[bytes, int]] | None = None):
        self.items = sorted({(i, t) for i, t in items if terms(t)}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        bags = [terms(t) for _, t in self.items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        n = len(bags)
        counts = [dict() for _ in self.vocabulary]
        for i, bag in enumerate(bags):
            for w in bag:
                own = counts[self.vocabulary[w]]
                own[i] = own.get(i, 0) + 1
        if whole is None:
            whole = n, sum(map(len, bags)), max(map(len, bags), default=1), {w: len(counts[k]) for w, k in self.vocabulary.items()}
        every, total, self.longest, held = whole
        mean, dfs = total / max(every, 1), [held[w] for w in self.vocabulary]
        raw = [{i: math.log(1 + (every - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(bags[i]) / mean)) for i, tf in c.items()} for c, df in zip(counts, dfs)]
        own = np.zeros(n)
        for c in raw:
            for i, v in c.items():
                own[i] += v
        self.postings = [sorted((i, v / own[i]) for i, v in c.items()) for c in raw]
        self.blocks = []
        for p in self.postings:
            top: dict[int, float] = {}
            for i, v in p:
                top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), v)
            self.blocks.append(top)
        sizes = [len(b) for b in self.blocks]
        self.block_start = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        self.block_id = np.array([k for b in self.blocks for k in b], np.int64)
        self.block_top = np.array([v for b in self.blocks for v in b.values()], np.float64)
        self.n_blocks = (n + BLOCK - 1) // BLOCK
        self.parts = [question_and_answer(t) for _, t in self.items]

    def may_reach(self, passage: np.ndarray, term: np.ndarray, n: int, theta: float) -> np.ndarray:
        """Numbers of the passages, of n, with a block whose summed maxima reach theta; rows are distinct (passage, term) in
        order of passage. Passages are taken together as long as they have at most WORK sums and summands."""
        sizes = self.block_start[term + 1] - self.block_start[term]
        work = np.bincount(passage, sizes + 0.0, n) + self.n_blocks
        group = (work.cumsum() // WORK).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
        found = []
        for s, e in zip(edges, edges[1:]):
            a, b = np.searchsorted(passage, [s, e])
            own = sizes[a:b]
            rows = np.repeat(np.arange(a, b), own)
            at = np.arange(len(rows)) - np.repeat(own.cumsum() - own, own) + self.block_start[term[rows]]
            sums = np.bincount((passage[rows] - s) * self.n_blocks + self.block_id[at], self.block_top[at], (e - s) * self.n_blocks)
            found.append(np.flatnonzero((sums.reshape(e - s, self.n_blocks) >= theta - 1e-9).any(1)) + s)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def wand(self, query: list[int], theta: float) -> list[tuple[int, float]]:
        """All (item number, score) of score theta or more, by block-max WAND over the query's postings."""
        lists = [self.postings[t] for t in query]
        tops = [max(v for _, v in p) for p in lists]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        theta -= 1e-9
        while live:
            live.sort(key=lambda k: lists[k][at[k]][0])
            bound, pivot = 0.0, -1
            for x, k in enumerate(live):
                bound += tops[k]
                if bound >= theta:
                    pivot = x
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK
            reach = sum(self.blocks[query[k]].get(block, 0.0) for k in live[: pivot + 1])
            if reach < theta:  # no item of this block before the next list's item can do it
                target = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                target = max(target, item + 1)
            else:
                score = sum(lists[k][at[k]][1] for k in live[: pivot + 1] if lists[k][at[k]][0] == item)
                if lists[live[0]][at[live[0]]][0] == item:
                    if score >= theta:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            for k in live[: pivot + 1]:
                p, x = lists[k], at[k]
                while x < len(p) and p[x][0] < target:
                    x += 1
                at[k] = x
            live = [k for k in live if at[k] < len(lists[k])]
        return found

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words (in its longest run) that are in words."""
        question, answer = self.parts[item]
        n = min(SHINGLE, len(question))
        if n:
            have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            own = {tuple(question[i : i + n]) for i in range(len(question) - n + 1)}
            asked = len(own & have) / len(own)
        else:
            asked = 1.0
        text, low, high = b" " + b" ".join(words) + b" ", 0, len(answer)
        while low < high:  # a run of n words has one of n - 1
            mid = (low + high + 1) // 2
            if any(b" " + b" ".join(answer[i : i + mid]) + b" " in text for i in range(len(answer) - mid + 1)):
                low = mid
            else:
                high = mid - 1
        return asked, low / len(answer)

    def matches(self, texts: list[str | None], theta: float = THRESHOLD) -> list[dict[int, tuple[float, float, float]]]:
        """For each text, item number -> (score, question overlap, answer overlap) of its verified items, best passage first."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not self.items or not texts:
            return found
        step, get = self.longest, self.vocabulary.get
        ids, first, segments = [], [0], 0
        words = [terms(t) for t in texts]
        for w in words:
            own = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
            ids.append((np.arange(len(w)) // step + segments, own))
            segments += (len(w) + step - 1) // step + 1  # an empty one after each text
            first.append(segments)
        segment, term = (np.concatenate(x) for x in zip(*ids))
        known = term >= 0
        width = len(self.vocabulary)
        key = segment[known] * width + term[known]
        # passage s is segments s and s + 1; the empty segments keep texts apart
        key = np.unique(np.concatenate([key, key[key >= width] - width]))
        passage, term = key // width, key % width
        likely = self.may_reach(passage, term, segments, theta)
        starts, ends = np.searchsorted(passage, likely), np.searchsorted(passage, likely + 1)
        owners = np.searchsorted(first, likely, side="right") - 1
        for p, s, e, d in zip(likely.tolist(), starts.tolist(), ends.tolist(), owners.tolist()):
            for item, score in self.wand(term[s:e].tolist(), theta):
                k = (p - first[d]) * step
                asked, answered = self.verify(item, words[d][max(k, 0) : k + 2 * step])
                if asked >= QUESTION and answered >= ANSWER:
                    found[d][item] = max(found[d].get(item, (0.0, 0.0, 0.0)), (round(float(score), 9), asked, answered))
        return found


_HELD: list = []


def _index(shared) -> Index:
    """The index of a broadcast, built once in a worker."""
    if not _HELD or _HELD[0] is not shared.value:
        _HELD[:] = [shared.value, Index(*shared.value)]
    return _HELD[1]


def _bags(batches):
    for b in batches:
        bags = [terms(t) for t in b.column(1).to_pylist()]
        held = pa.array([sorted(set(x)) for x in bags], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, bags)), pa.int64()), held], ["shard", "size", "terms"])


def indexes(benchmark: DataFrame, most: int = INDEX_CHARS) -> list[tuple]:
    """Index's arguments: the items, in shards of about most characters, and from two shards on what is known of the whole; each is collected by itself."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / most))
    if n == 1:
        yield [tuple(r) for r in items.collect()], None
        return
    dealt = items.distinct().withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    bags = dealt.select("shard", "text").mapInArrow(_bags, "shard int, size long, terms array<binary>").where("size > 0")
    every = tuple(bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first())
    held = bags.select("shard", F.explode("terms").alias("term"))
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for k in range(n):
        own = frequency.join(held.where(F.col("shard") == k), "term", "left_semi")
        yield [tuple(r) for r in dealt.where(F.col("shard") == k).select("item_id", "text").collect()], (*every, {bytes(w): df for w, df in own.collect()})


def contaminated(docs: DataFrame, benchmark: DataFrame, theta: float = THRESHOLD, most: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all verified matches, a row for each item."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for items in indexes(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = _index(shared)
            for b in sliced(batches, 1, rows=400):
                rows = [(d, index.items[i][0], *x) for d, own in zip(b.column(0).to_pylist(), index.matches(b.column(1).to_pylist(), theta)) for i, x in sorted(own.items())]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, theta: float = THRESHOLD, most: int = INDEX_CHARS) -> DataFrame:
    """docs without those that hold a verified item."""
    at = docs.columns.index("text")
    for items in indexes(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = _index(shared)
            for b in sliced(batches, at, rows=400):
                yield b.filter(pa.array([not m for m in index.matches(b.column(at).to_pylist(), theta)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
