"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of BLOCK words, which are indexed by hash. The
rolling window of BLOCK words at every word of every document probes the index. A repeat of at least
2 * BLOCK words holds a whole block of either side, so its windows hit; hits are extended to all
runs of 2 * BLOCK words around them, and each such run's hash is asked for in which documents it
starts. Consecutive runs found in an earlier document make up the maximal repeats, whose
words are removed. Blocks and probes, and then runs, are exchanged packed (see packed.py); texts
are dealt out once, by batch, and stay put.

Equality of runs is equality of 64-bit hashes of their words. Defined results: null and blank texts
have no words; a row without doc_id is no document: it keeps all its words and takes none; of documents with the same run the smallest doc_id keeps it; rows that repeat a
doc_id keep what they share with each other; repeats inside a document stay; very long texts are hashed
whole, in their batch; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import Hasher, chunks, in_sorted, low, part_of, plan, split_by_part

BLOCK = 25
_SENT = "part int, batch int, a binary, b binary, c binary"
_EMPTY32, _EMPTY64 = np.zeros(0, np.uint32), np.zeros(0, np.uint64)


def _table(rows: list[tuple], names: str, types: tuple) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names.split(), cols, types)})


_SENT_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _read(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


class Windows:
    """The words of a batch's texts, in order of doc_id, and the windows at every word."""

    def __init__(self, hasher: Hasher, ids: list[int], texts: list[str | None]):
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        self.ids, self.order = np.array([ids[k] for k in order], np.int64), order
        found = [hasher.words(data) for _, _, data in chunks([texts[k] for k in order])]
        self.words = np.concatenate([f[0] for f in found]) if found else _EMPTY64
        self.counts = np.concatenate([f[1] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        self.ends = self.counts.cumsum()
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.hasher = hasher

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of k words that stay in their document."""
        h = self.hasher.runs(self.words, k)
        at = np.flatnonzero(self.ends[self.doc[: len(h)]] - np.arange(len(h)) >= k)
        return at, h[at]


def _sent(batch: int, h: np.ndarray, n_parts: int, make) -> list[tuple]:
    return [(p, batch, *make(at)) for p, at in split_by_part(h, n_parts)]


def removal(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words left, joined by one space, as UTF-8."""
    return _pipeline(docs, block, digest=False)


def _pipeline(docs: DataFrame, block: int, digest: bool) -> DataFrame:
    dealt, _, n_parts = plan(docs.where("doc_id is not null"))
    by_batch = dealt.groupBy("batch")
    whole = 2 * block

    def windows(t: pa.Table) -> Windows:
        return Windows(Hasher(fold_case=False), t.column("doc_id").to_pylist(), t.column("text").to_pylist())

    def emit_probes(t: pa.Table) -> pa.Table:
        """Blocks, probes of one document and probes of several, as the low halves of their hashes."""
        w, batch = windows(t), t.column("batch")[0].as_py()
        at, h = w.runs(block)
        aligned = np.unique(h[(at - (w.ends - w.counts)[w.doc[at]]) % block == 0])
        # distinct (hash, document) first: a hash of two documents is shared already
        order = np.argsort(h, kind="stable")  # documents stay in order
        h, d = h[order], w.doc[at[order]]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = first.cumsum() - 1
        probes = h[first]
        several = np.zeros(len(probes), bool)
        several[group[1:][(d[1:] != d[:-1]) & ~first[1:]]] = True
        rows: dict[int, list[bytes]] = {}
        for k, x in enumerate((aligned, probes[~several], probes[several])):
            for p, own in split_by_part(x, n_parts):
                rows.setdefault(p, [b"", b"", b""])[k] = np.sort(low(x[own])).tobytes()
        return _table([(p, batch, *x) for p, x in rows.items()], "part batch a b c", _SENT_TYPES)

    def answer_probes(t: pa.Table) -> pa.Table:
        """To each batch its probes that hit an indexed block and that another document holds too."""
        batches = t.column("batch").to_pylist()
        blocks, one, several = (_read(t.column(c), np.uint32) for c in "abc")
        index = np.unique(np.concatenate(blocks))
        hits = [np.concatenate([a[in_sorted(a, index)], b[in_sorted(b, index)]]) for a, b in zip(one, several)]
        values, counts = np.unique(np.concatenate(hits), return_counts=True)
        shared = np.union1d(values[counts > 1], np.concatenate([b[in_sorted(b, index)] for b in several]))
        part = t.column("part")[0].as_py()
        out = [(part, k, x.tobytes(), b"", b"") for k, h in zip(batches, hits) if len(x := h[in_sorted(h, shared)])]
        return _table(out, "part batch a b c", _SENT_TYPES)

    def emit_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs around hits: documents in order, how many runs each is first of in the batch, and their hashes."""
        if not left.num_rows or not right.num_rows:
            return _table([], "part batch a b c", _SENT_TYPES)
        w, batch = windows(left), left.column("batch")[0].as_py()
        at, h = w.runs(block)
        key = part_of(h, n_parts) << np.uint64(32) | low(h).astype(np.uint64)
        wanted = np.concatenate([np.uint64(p) << np.uint64(32) | x.astype(np.uint64) for p, x in zip(right.column("part").to_pylist(), _read(right.column("a"), np.uint32))])
        hit = np.zeros(len(w.words) + 1, np.int64)
        places = at[in_sorted(key, np.sort(wanted))]
        np.add.at(hit, np.maximum(places - block, 0), 1)  # a run from here on up to the hit holds it
        np.add.at(hit, places + 1, -1)
        near = hit.cumsum() > 0
        at, h = w.runs(whole)
        own = near[at]
        at, h = at[own], h[own]
        h, first = np.unique(h, return_index=True)  # the first place is in the smallest document
        doc = w.doc[at[first]]
        rows = []
        for p, x in split_by_part(h, n_parts):
            x = x[np.argsort(doc[x], kind="stable")]
            d, n = np.unique(doc[x], return_counts=True)
            rows.append((p, batch, w.ids[d].tobytes(), n.astype(np.uint32).tobytes(), h[x].tobytes()))
        return _table(rows, "part batch a b c", _SENT_TYPES)

    def answer_runs(t: pa.Table) -> pa.Table:
        """To each batch its runs that start in a smaller document of another batch."""
        batches, part = t.column("batch").to_pylist(), t.column("part")[0].as_py()
        docs_of, counts, hashes = (_read(t.column(c), k) for c, k in (("a", np.int64), ("b", np.uint32), ("c", np.uint64)))
        h, d = np.concatenate(hashes), np.concatenate([np.repeat(a, n) for a, n in zip(docs_of, counts)])
        owner = np.repeat(np.arange(len(batches)), [len(x) for x in hashes])
        order = np.lexsort((d, h))
        h, d, owner = h[order], d[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        least = d[first][first.cumsum() - 1]
        late = d > least
        h, owner = h[late], owner[late]
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(batches) + 1))
        out = [(part, batches[k], h[order[s:e]].tobytes(), b"", b"") for k, (s, e) in enumerate(zip(edges, edges[1:])) if s < e]
        return _table(out, "part batch a b c", _SENT_TYPES)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cover the runs that start in an earlier document, here or elsewhere, and drop the words."""
        w, texts = windows(left), left.column("text").to_pylist()
        at, h = w.runs(whole)
        order = np.argsort(h, kind="stable")
        hs, d = h[order], w.ids[w.doc[at[order]]]
        first = np.ones(len(hs), bool)
        first[1:] = hs[1:] != hs[:-1]
        late = np.zeros(len(h), bool)
        late[order] = d > d[first][first.cumsum() - 1]
        elsewhere = np.concatenate(_read(right.column("a"), np.uint64)) if right.num_rows else _EMPTY64
        late |= in_sorted(h, np.sort(elsewhere))
        cover = np.zeros(len(w.words) + 1, np.int64)
        np.add.at(cover, at[late], 1)
        np.add.at(cover, at[late] + whole, -1)
        gone = cover.cumsum()[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(w.ids))
        out = []
        for k, (s, e, n) in enumerate(zip((w.ends - w.counts).tolist(), w.ends.tolist(), removed.tolist())):
            words = (texts[w.order[k]] or "").encode("utf-8", "replace").split()
            if n:
                words = [x for x, g in zip(words, gone[s:e].tolist()) if not g]
            kept = b" ".join(words)
            out.append((int(w.ids[k]), e - s, n, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")))
        return _table(out, "doc_id n_words n_removed kept", (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    def untouched(batches):
        for b in batches:
            kept = [b" ".join((t or "").encode("utf-8", "replace").split()) for t in b.column(1).to_pylist()]
            text = [hashlib.sha256(k).hexdigest() if digest else k.decode("utf-8") for k in kept]
            sizes = pa.array([len(k.split()) for k in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array([0] * b.num_rows, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    probes = by_batch.applyInArrow(emit_probes, _SENT)
    hits = probes.groupBy("part").applyInArrow(answer_probes, _SENT)
    runs = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(emit_runs, _SENT)
    earlier = runs.groupBy("part").applyInArrow(answer_runs, _SENT)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    others = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(untouched, schema)
    return by_batch.cogroup(earlier.groupBy("batch")).applyInArrow(finish, schema).unionByName(others)


def removal_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The digest columns of the contract, a row per document."""
    return _pipeline(docs, block, digest=True).withColumnRenamed("kept", "kept_sha256")
