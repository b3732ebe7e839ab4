"""Substring dedup by merging the Burrows-Wheeler transforms of shards.

Only strings of SPAN bytes that two documents may share are sorted. Every window of SPAN bytes has a
seed, the SEED bytes of least hash in it, so equal windows have equal seeds. Seeds are exchanged packed
(see packed.py); runs of windows whose seed is in one document only are done. The other runs, of at
most SPAN - SEED + 1 windows each, are the fragments.

A shard is about SHARD_BYTES of the fragments of a batch, each text once. Its suffixes are sorted once and
its Burrows-Wheeler transform is cut by hash of the seed: for each part, the byte before each suffix that lies in
the part's fragments, in order of the suffixes. A part merges the transforms of all shards. It starts
with the suffixes that follow each window, shard after shard, and refines that interleave by one stable
pass over the bytes before them at a time, going from each suffix to the one before by the transform
itself (LF mapping). A block of suffixes is a common prefix; passes split blocks, and those left after SPAN bytes are the
repeated intervals. No suffix is sorted a second time and no text is sent. The windows of an
interval that are not in its smallest document are late; each batch removes the bytes that its late
windows cover.

Seeds that a share of a bounded sample of documents hold are taken only where a window has no others, so
that a passage's edges, whose windows differ from document to document, do not meet in one part. That
moves work and no result.

Equality of fragments inside a batch is equality of 64-bit hashes; windows of different fragments are compared byte by byte.
Defined results: a null or empty text has no bytes, and a text under SPAN bytes no window; a row without doc_id is no
document: it keeps all its bytes and takes none; of documents with the same window the smallest
doc_id keeps it, rows that repeat a doc_id keep what they share with each other; repeats inside a
document stay; very long texts are read whole, in their batch; an empty table gives an empty result;
extra columns, whatever their names, are ignored. Text columns hold UTF-8, which has no byte FF.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .packed import _BASE, _INVERSE, STEADY_BYTES, _powers, in_sorted, low, mix, part_of, sizes, split_by_part

SPAN, SEED = 50, 20
#: Bytes of fragments sorted at once, and bytes of text whose fragments a part merges.
SHARD_BYTES, MERGED_BYTES = 1_000_000, 4_000_000
#: Seeds in 1 of RARE documents of a sample of about SAMPLE documents of up to SAMPLE_BYTES are taken last, at most FREQUENT of them.
SAMPLE, SAMPLE_BYTES, RARE, FREQUENT = 600, 100_000, 100, 50_000
_CHUNK = 1 << 15
_END = 0xFF
_SENT = "part int, batch int, a binary, b binary, c binary, d binary, e binary"
_SENT_SCHEMA = pa.schema([("part", pa.int32()), ("batch", pa.int32()), *((c, pa.binary()) for c in "abcde")])
_LEFT = "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*(r + (b"",) * (7 - len(r)) for r in rows))) or [()] * 7
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SENT_SCHEMA)], schema=_SENT_SCHEMA)


def _read(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)


def _starts(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], flags])) if len(flags) else np.zeros(0, np.int64)


class Seeds:
    """The order of seeds: by hash, with the frequent ones last."""

    def __init__(self, span: int, seed: int, frequent: np.ndarray):
        self.span, self.seed, self.window = span, seed, span - seed + 1
        self.late = np.zeros(1 << 20, bool)
        self.late[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.any = bool(len(frequent))
        self.values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.up, self.down = _powers(_BASE, _CHUNK + 2 * span), _powers(_INVERSE, _CHUNK + 2 * span)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """The hash of the seed at every place of a short array, as far as they fit."""
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        n = len(raw) - self.seed + 1
        return mix((sums[self.seed :] - sums[: -self.seed]) * self.down[:n])

    def least(self, raw: np.ndarray) -> np.ndarray:
        """The least seed of the window at every place."""
        h = self.hashes(raw)
        rank = h >> np.uint64(1)
        if self.any:
            rank[self.late[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]] |= np.uint64(1 << 63)
        width = 1
        while 2 * width <= self.window:
            rank = np.minimum(rank[:-width], rank[width:])
            width *= 2
        if rest := self.window - width:
            rank = np.minimum(rank[:-rest], rank[rest:])
        return rank

    def fragments(self, raw: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, seed) of every run of windows of one seed; open_ tells at which
        places a window stands. raw is padded with span bytes."""
        n, found, last, was = len(open_), [], np.uint64(0), False
        for a in range(0, n, _CHUNK):
            b = min(n, a + _CHUNK)
            seeds, own = self.least(raw[a : b + self.span - 1])[: b - a], open_[a:b]
            edge = np.empty(b - a, bool)
            edge[1:] = (own[1:] != own[:-1]) | (own[1:] & (seeds[1:] != seeds[:-1]))
            edge[0] = own[0] != was or (own[0] and seeds[0] != last)
            at = np.flatnonzero(edge)
            found.append((at + a, own[at], seeds[at]))
            last, was = seeds[-1], bool(own[-1])
        at, own, seeds = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64))
        count = np.diff(np.append(at, n))[own]
        at, seeds = at[own], seeds[own]
        times = -(-count // self.window)  # a seed that repeats may make a longer run
        if (times > 1).any():
            piece = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
            count = np.minimum(np.repeat(count, times) - piece * self.window, self.window)
            at, seeds = np.repeat(at, times) + piece * self.window, np.repeat(seeds, times)
        return at, count, seeds


class Batch:
    """The bytes of a batch's texts, in order of doc_id."""

    def __init__(self, t: pa.Table, span: int):
        t = t.take(pc.sort_indices(t.column("doc_id")))
        text = pc.fill_null(pc.cast(t.column("text"), pa.large_binary()), b"")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.ids = t.column("doc_id").to_numpy()
        self.bounds = bounds - bounds[0]
        self.n = len(data)
        self.raw = np.concatenate([data, np.zeros(2 * span, np.uint8)])
        edge = np.zeros(self.n + 1, np.int32)
        lengths = np.diff(self.bounds)
        whole = lengths >= span
        np.add.at(edge, self.bounds[:-1][whole], 1)
        np.add.at(edge, (self.bounds[1:] - span + 1)[whole], -1)
        self.open = edge[:-1].cumsum() > 0

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The doc_id at each place."""
        return self.ids[np.searchsorted(self.bounds[1:], places, side="right")]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of data, which ends with a byte FF that stands for its end, in order; by doubling, with ties only."""
    n = len(data)
    key = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = (key[:-width] << np.uint64(8 * width)) | key[width:]
    key = key[:n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    h = 8
    while len(tied := np.flatnonzero(~(new & np.append(new[1:], True)))):
        suffix = order[tied]
        after = suffix + h
        key = rank[suffix] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        h *= 2
    return order


def transform(raw: np.ndarray, at: np.ndarray, count: np.ndarray, part: np.ndarray, span: int):
    """The transform of a shard's fragments, a part after the other: (part, byte before each suffix, places of the
    fragments' last suffixes, the fragments in that order). Fragments come by place and may overlap; a fragment's first
    suffix has the byte FF before it."""
    length = count + span - 1
    ends = at + length
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > ends[:-1]
    piece = new.cumsum() - 1
    begin, last = at[new], ends[np.append(new[1:], True)]
    size = last - begin + 1
    offset = size.cumsum() - size
    data = raw[np.arange(size.sum()) + np.repeat(begin - offset, size)]
    data[offset + size - 1] = _END
    first = at - begin[piece] + offset[piece]  # of each fragment in data
    order = suffix_array(data)
    n = len(data)
    over = np.bincount(first + length + 1, minlength=n + 1)[: n + 1].cumsum()  # fragments that end before a place
    cover = np.bincount(first, minlength=n).cumsum() - over[:n]
    times = cover[order]
    place = np.repeat(order, times)
    fragment = over[place] + np.arange(len(place)) - np.repeat(times.cumsum() - times, times)
    step = place - first[fragment]
    before = data[place - 1]
    before[step == 0] = _END
    final = step == length[fragment]
    own = part[fragment]
    by = np.argsort(own.astype(np.uint16) if own.max() < 1 << 16 else own, kind="stable")
    own, before, final, fragment = own[by], before[by], final[by], fragment[by]
    edges = np.append(_starts(own[1:] != own[:-1]), len(own))
    for s, e in zip(edges, edges[1:]):
        ended = np.flatnonzero(final[s:e])
        yield int(own[s]), before[s:e], ended, fragment[s:e][ended]


def lf_mapping(before: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """From each suffix of a transform to the suffix one byte longer; those of fragments' starts stay."""
    lf = np.arange(len(before), dtype=np.int32)
    inner = np.flatnonzero(before != _END)
    started = np.ones(len(before), bool)
    started[ended] = False
    lf[inner[np.argsort(before[inner], kind="stable")]] = np.flatnonzero(started)
    return lf


def interleave(before: np.ndarray, lf: np.ndarray, places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes span bytes before places in order of those bytes, and the block of each: suffixes of
    a block share span bytes. places come shard after shard, each in its order; a pass takes four bytes where
    the parts' texts have few enough different ones."""
    two = (before[lf].astype(np.uint16) << np.uint16(8)) | before
    lf2 = lf[lf]
    seen = np.zeros(1 << 16, bool)
    seen[two] = True
    dense, kinds = np.cumsum(seen) - 1, int(seen.sum())
    passes = [(two, lf2)] * (span // 2)
    if kinds * kinds <= 1 << 25:
        four = dense.astype(np.int32)[two]
        four = four[lf2] * np.int32(kinds) + four
        seen = np.zeros(kinds * kinds, bool)
        seen[four] = True
        if (held := int(seen.sum())) <= 1 << 16:
            four = (np.cumsum(seen, dtype=np.int32) - 1).astype(np.uint16)[four]
            passes = [(four, lf2[lf2])] * (span // 4) + [(two, lf2)] * (span % 4 // 2)
        del held
    if span % 2:
        passes = [*passes, (before, lf)]
    z = places.astype(np.int32)
    block = np.zeros(len(z), np.int32)
    for code, back in passes:
        code = code[z]
        by = np.argsort(code, kind="stable")
        z, code, block = back[z[by]], code[by], block[by]
        split = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        block[:1] = 0
        np.cumsum(split, out=block[1:])
    return z, block


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, window, owner is not the least) of every window of the shards (transform, last suffixes, windows of each
    fragment, owner of each fragment), in the order of the merged transform. Fragments count on from shard to shard."""
    offsets = np.cumsum([0, *(len(s[0]) for s in shards)])
    before = np.concatenate([s[0] for s in shards])
    lf = np.concatenate([lf_mapping(s[0], s[1]) + np.int32(o) for s, o in zip(shards, offsets)])
    place = np.concatenate([s[1] + o for s, o in zip(shards, offsets)]).astype(np.int32)
    count, owner = np.concatenate([s[2] for s in shards]).astype(np.int64), np.concatenate([s[3] for s in shards])
    fragment, window = np.zeros(len(before), np.int32), np.zeros(len(before), np.uint8)
    follows = np.zeros(len(before), bool)
    step, own = count + span - 1, np.arange(len(count), dtype=np.int32)
    while len(own):  # back through all fragments at once, a byte at a time
        is_window, is_after = step < count[own], step >= span
        follows[place[is_after]] = True
        fragment[place[is_window]], window[place[is_window]] = own[is_window], step[is_window]
        more = step > 0
        place, own, step = lf[place[more]], own[more], step[more] - 1
    z, block = interleave(before, lf, np.flatnonzero(follows), span)
    holder = owner[fragment[z]]
    least = np.minimum.reduceat(holder, _starts(block[1:] != block[:-1])) if len(z) else holder
    return fragment[z], window[z], holder > least[block]


def frequent_seeds(docs: DataFrame, span: int, seed: int) -> np.ndarray:
    """Hashes of seeds that are in 1 of RARE documents of a sample."""
    n = docs.count()
    share = max(1, n // SAMPLE)
    sample = docs.where((F.octet_length("text") >= span) & (F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)).select("text")
    order = Seeds(span, seed, np.zeros(0, np.uint64))

    def held(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                h = np.unique(np.concatenate([order.hashes(raw[a : a + _CHUNK + seed - 1]) for a in range(0, len(raw) - seed + 1, _CHUNK)]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counted = sample.mapInArrow(held, "h long").groupBy("h").count().where(F.col("count") >= max(3, min(n, SAMPLE) // RARE))
    return np.array([r.h for r in counted.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)


def repeats(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): spans are the maximal runs of bytes that windows of span bytes cover which
    also start in a document with a smaller doc_id, kept the other bytes."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select("doc_id", "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_parts = sizes(total, partitions(spark))
    grown = min(4.0, math.sqrt(max(1.0, total / STEADY_BYTES)))
    n_merges = max(partitions(spark), int(total / (MERGED_BYTES * grown)))
    dealt = known.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int"))
    by_batch = dealt.groupBy("batch")
    order = Seeds(span, seed, frequent_seeds(known, span, seed))
    bits = np.uint64(32)

    def emit_seeds(t: pa.Table) -> pa.Table:
        """The batch's seeds, those of one document and those of several, as low halves of their hashes."""
        b, batch = Batch(t, span), t.column("batch")[0].as_py()
        at, _, seeds = order.fragments(b.raw, b.open)
        by = np.argsort(seeds, kind="stable")
        h, doc = mix(seeds[by]), b.owner(at[by])
        first = _starts(h[1:] != h[:-1])
        several = np.zeros(len(first), bool)
        if len(h):
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        h, rows = h[first], {}
        for k, x in enumerate((h[~several], h[several])):
            for p, own in split_by_part(x, n_parts):
                rows.setdefault(p, [b"", b""])[k] = np.sort(low(x[own])).tobytes()
        return _rows([(p, batch, *x) for p, x in rows.items()])

    def answer_seeds(t: pa.Table) -> pa.Table:
        """To each batch its seeds that another document holds too."""
        part, batches = t.column("part")[0].as_py(), t.column("batch").to_pylist()
        one, several = _read(t.column("a"), np.uint32), _read(t.column("b"), np.uint32)
        values, counts = np.unique(np.concatenate(one + several), return_counts=True)
        shared = np.union1d(values[counts > 1], np.concatenate(several))
        held = [np.concatenate([a[in_sorted(a, shared)], b]) for a, b in zip(one, several)]
        return _rows([(part, k, x.tobytes()) for k, x in zip(batches, held) if len(x)])

    def emit_transforms(left: pa.Table, right: pa.Table) -> pa.Table:
        """A shard's transform for each part, and to the batch itself (part below 0) what its own copies tell."""
        if not left.num_rows or not right.num_rows:
            return _rows([])
        b, batch = Batch(left, span), left.column("batch")[0].as_py()
        at, count, seeds = order.fragments(b.raw, b.open)
        h = mix(seeds)
        wanted = np.concatenate([np.uint64(p) << bits | x.astype(np.uint64) for p, x in zip(right.column("part").to_pylist(), _read(right.column("a"), np.uint32))])
        shared = in_sorted(part_of(h, n_parts) << bits | low(h).astype(np.uint64), np.sort(wanted))
        at, count, h = at[shared], count[shared], h[shared]
        # fragments of one text once, in their smallest document
        content = np.empty(len(at), np.uint64)
        wide = -(-(span + order.window - 1) // 8) * 8
        padded = np.concatenate([b.raw, np.zeros(wide, np.uint8)])
        salts = mix(np.arange(1, wide // 8 + 1, dtype=np.uint64))
        for s in range(0, len(at), 20_000):
            text = sliding_window_view(padded, wide)[at[s : s + 20_000]]
            text[np.arange(wide) >= (count[s : s + 20_000] + span - 1)[:, None]] = 0
            content[s : s + 20_000] = mix(mix(text.view(np.uint64) ^ salts).sum(axis=1, dtype=np.uint64) + count[s : s + 20_000].astype(np.uint64))
        by = np.argsort(content, kind="stable")
        lead = np.ones(len(by), bool)
        lead[1:] = content[by][1:] != content[by][:-1]
        leader = np.empty(len(at), np.int64)
        leader[by] = by[lead][lead.cumsum() - 1] if len(by) else 0
        copies = np.flatnonzero(leader != np.arange(len(at)))
        earlier = b.owner(at[copies]) > b.owner(at[leader[copies]])
        late, same = copies[earlier], copies[~earlier]
        rows = []
        if len(copies):
            where = [x.astype(np.uint32).tobytes() for x in (at[late], at[same], at[leader[same]])]
            rows.append((-1 - batch, batch, where[0], count[late].astype(np.uint8).tobytes(), where[1], where[2], count[same].astype(np.uint8).tobytes()))
        kept = np.flatnonzero(leader == np.arange(len(at)))
        at, count, part = at[kept], count[kept], ((h[kept] >> bits) % np.uint64(n_merges)).astype(np.int64)
        owner, held = b.owner(at), (count + span).cumsum()
        for s, e in _slices(held // SHARD_BYTES):
            for p, before, ended, own in transform(b.raw, at[s:e], count[s:e], part[s:e], span):
                own = own + s
                rows.append((p, batch, before.tobytes(), ended.astype(np.uint32).tobytes(), count[own].astype(np.uint8).tobytes(), at[own].astype(np.uint32).tobytes(), owner[own].tobytes()))
        return _rows(rows)

    def merge(t: pa.Table) -> pa.Table:
        """To each batch its late windows, as first places and lengths of their runs."""
        part = t.column("part")[0].as_py()
        if part < 0:
            return t.select(_SENT_SCHEMA.names).cast(_SENT_SCHEMA)
        batch = t.column("batch").to_pylist()
        before, ended, count, at, owner = (_read(t.column(c), k) for c, k in zip("abcde", (np.uint8, np.uint32, np.uint8, np.uint32, np.int64)))
        fragment, window, late = merged(list(zip(before, ended, count, owner)), span)
        own = np.sort(fragment[late].astype(np.int64) * 256 + window[late])
        first = _starts(own[1:] != own[:-1] + 1)
        n = np.diff(np.append(first, len(own)))
        fragment, window = own[first] >> 8, own[first] & 255
        start = np.concatenate(at)[fragment].astype(np.int64) + window
        row = np.repeat(np.arange(len(batch)), [len(x) for x in count])[fragment]
        return _rows([(part, batch[row[s]], start[s:e].astype(np.uint32).tobytes(), n[s:e].astype(np.uint8).tobytes()) for s, e in _slices(row)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Drop what late windows cover."""
        b = Batch(left, span)
        start, n, twin, lead, m = (_joined(_read(right.column(c), k), np.int64) for c, k in zip("abcde", (np.uint32, np.uint8, np.uint32, np.uint32, np.uint8)))
        edge = np.zeros(b.n + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n, -1)
        late = edge[:-1].cumsum() > 0
        step = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
        late[np.repeat(twin, m) + step] |= late[np.repeat(lead, m) + step]
        so_far = np.concatenate([np.zeros(span, np.int64), late.cumsum()])
        return _left(b, so_far[span:] > so_far[:-span] if b.n else late)

    def untouched(batches):
        for batch in batches:
            b = Batch(pa.table({"doc_id": pa.array([0] * batch.num_rows, pa.int64()), "text": batch.column(0)}), span)
            t = _left(b, np.zeros(b.n, bool))
            yield from t.set_column(0, "doc_id", pa.nulls(t.num_rows, pa.int64())).to_batches()

    hits = by_batch.applyInArrow(emit_seeds, _SENT).groupBy("part").applyInArrow(answer_seeds, _SENT)
    shards = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(emit_transforms, _SENT)
    answers = shards.groupBy("part").applyInArrow(merge, _SENT)
    others = docs.where("doc_id is null").select("text").mapInArrow(untouched, _LEFT)
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(finish, _LEFT).unionByName(others)


def _slices(key: np.ndarray):
    """(first, last + 1) of the runs of equal values."""
    edges = np.append(_starts(key[1:] != key[:-1]), len(key))
    return zip(edges.tolist(), edges[1:].tolist()) if len(key) else []


def _left(b: Batch, gone: np.ndarray) -> pa.Table:
    """The rows of a batch's documents without the bytes that are gone."""
    n = len(b.ids)
    edge = np.zeros(b.n, bool)
    if b.n:
        edge[0] = True
        edge[1:] = gone[1:] != gone[:-1]
        edge[b.bounds[:-1][b.bounds[:-1] < b.n]] = True
    starts = np.flatnonzero(edge)
    lengths, removed = np.diff(np.append(starts, b.n)), gone[starts]
    starts, lengths = starts[removed], lengths[removed]
    doc = np.searchsorted(b.bounds[1:], starts, side="right")
    held = np.concatenate([[0], np.bincount(doc, minlength=n).cumsum()]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(starts - b.bounds[doc]), pa.array(lengths)], ["start", "length"])
    so_far = np.concatenate([[0], (~gone).cumsum()])
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(so_far[b.bounds].astype(np.int32).tobytes()), pa.py_buffer(b.raw[: b.n][~gone].tobytes())])
    return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array(np.diff(b.bounds), pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(held, pa.int32()), spans), "kept": kept})


def repeat_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, a row per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
