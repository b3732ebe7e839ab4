"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's tokens are its distinct word shingles, ordered by document frequency and then by hash.
If two documents' similarity reaches the threshold, their prefixes of length n - ceil(t * n) + l
share l tokens. Each document chooses its l by estimated cost: a longer prefix means more postings
to read, but fewer documents that share l of its tokens. A pair is verified if it shares the smaller
of the two documents' l.

Frequencies come from a packed exchange (see packed.py). A document with too few tokens that any
other document has links with nothing and takes no further part. Equal sets are one node, and copies
in a batch one row. Documents that share a prefix token, directly or through others, are brought
together. Where that chains more than GROUP documents, their postings are read again with a parity
bitmap of each set, which bounds the overlap of two sets from above; only pairs within the bound stay
connected, so chains of unlike documents fall apart. What is still too large for one task, near copies
in the main, is dealt in pairs of blocks. Tasks report, for each node, its links and a forest of them,
so no list of pairs is ever made; the forest's components are found with DataFrame joins.

Defined results: texts without words have no tokens and link with nothing; rows that repeat a
doc_id are one node with each row's set; rows without doc_id link with nothing and have no
component_id; ties in order are broken by hash; very long texts are sets like others; an empty table
gives an empty result; extra columns, whatever their names, pass through the filter. Shingles are equal
if their 64-bit hashes are; document frequencies, which only order tokens, are counted by the part
and the low 32 bits of the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, saved
from .components import components
from .packed import Hasher, chunks, in_sorted, low, mix, part_of, plan, split_by_part

LONGEST = 4
#: Nodes of a group that one task takes, and of a block of a larger group.
GROUP, BLOCK = 1000, 500
#: Bytes of sets or postings aimed at in a task.
TASK_BYTES = 8_000_000
#: Least and largest 64-bit words of a set's bitmap; about half a bit a token between them.
WORDS = (8, 128)
_SENT = "part int, batch int, a binary, b binary, c binary"
_SENT_TYPES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_SET = "doc_id long, n long, key string, ids array<long>, ell int, base int, prefix array<long>, shared binary"


def _table(rows: list[tuple], names: str, types: tuple) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names.split(), cols, types)})


def shingle_sets(texts: list[str | None], words: int, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash), distinct and in that order; a shorter text is one shingle whole."""
    hasher, docs, hashes = Hasher(fold_case), [], []
    for first, _, data in chunks(texts):
        w, counts = hasher.words(data)
        ends = counts.cumsum()
        doc = np.repeat(np.arange(len(counts)), counts)
        h = hasher.runs(w, words)
        at = np.flatnonzero(ends[doc[: len(h)]] - np.arange(len(h)) >= words)
        docs.append(doc[at] + first)
        hashes.append(h[at])
        for k in np.flatnonzero((counts > 0) & (counts < words)).tolist():
            n = int(counts[k])
            docs.append(np.array([k + first]))
            hashes.append(hasher.runs(w[ends[k] - n : ends[k]], n, salt=1))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def choose(df: np.ndarray, n: int, least: int) -> int:
    """The l of least estimated cost, for a document's frequencies in order: postings to read, and
    n tokens to verify for each document that may share l of them."""
    best, ell = None, 1
    for x in range(1, LONGEST + 1):
        read = float((df[: n - least + x] - 1).sum())
        cost = read + n * read / x**2
        if best is None or cost < best:
            best, ell = cost, x
    return ell


def document_sets(docs: DataFrame, words: int, num: int, den: int, fold_case: bool) -> DataFrame:
    """A row for each set of a batch: its least document, number of tokens, key and documents, and for sets that may
    link the chosen l, how many prefix tokens l = 1 needs, the prefix and the tokens that other documents have."""
    dealt, _, n_parts = plan(docs.where("doc_id is not null"))
    by_batch = dealt.groupBy("batch")

    def emit(t: pa.Table) -> pa.Table:
        _, h = shingle_sets(t.column("text").to_pylist(), words, fold_case)
        values, counts = np.unique(h, return_counts=True)
        rows = []
        for p, own in split_by_part(values, n_parts):
            x, c = low(values[own]), counts[own]
            once, more = np.sort(x[c == 1]), c > 1
            rows.append((p, t.column("batch")[0].as_py(), once.tobytes(), x[more].tobytes(), c[more].astype(np.uint32).tobytes()))
        return _table(rows, "part batch a b c", _SENT_TYPES)

    def answer(t: pa.Table) -> pa.Table:
        read = lambda c: [np.frombuffer(x or b"", np.uint32) for x in t.column(c).to_pylist()]
        once, more, counts = read("a"), read("b"), read("c")
        keys = np.concatenate(once + more)
        weight = np.concatenate([np.ones(sum(map(len, once)), np.int64), *(c.astype(np.int64) for c in counts)])
        values, at = np.unique(keys, return_inverse=True)
        df = np.bincount(at, weight, len(values)).astype(np.uint32)
        keep = df > 1
        values, df = values[keep], df[keep]
        part, rows = t.column("part")[0].as_py(), []
        for batch, a, b in zip(t.column("batch").to_pylist(), once, more):
            x = np.unique(np.concatenate([a, b]))
            x = x[in_sorted(x, values)]
            if len(x):
                rows.append((part, batch, x.tobytes(), df[np.searchsorted(values, x)].tobytes(), b""))
        return _table(rows, "part batch a b c", _SENT_TYPES)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_pylist()
        d, h = shingle_sets(left.column("text").to_pylist(), words, fold_case)
        df = np.ones(len(h), np.int64)
        if right.num_rows:
            known = [(np.uint64(p) << np.uint64(32) | np.frombuffer(a, np.uint32).astype(np.uint64), np.frombuffer(b, np.uint32)) for p, a, b in zip(*(right.column(c).to_pylist() for c in ("part", "a", "b")))]
            keys, values = (np.concatenate(x) for x in zip(*known))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            mine = part_of(h, n_parts) << np.uint64(32) | low(h).astype(np.uint64)
            hit = in_sorted(mine, keys)
            df[hit] = values[np.searchsorted(keys, mine[hit])]
        edges = np.searchsorted(d, np.arange(len(ids) + 1))
        rows: dict[str | None, list] = {}
        for doc, s, e in zip(ids, edges.tolist(), edges[1:].tolist()):
            n = e - s
            own, f = h[s:e], df[s:e]
            key = f"{int(mix(own).sum()):016x}{int(mix(own ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum()):016x}" if n else None
            if key in rows:
                rows[key][0] = min(rows[key][0], doc)
                rows[key][3].append(doc)
                continue
            least = -(-num * n // den)
            common = int((f > 1).sum())
            if not n or common < least:
                rows[key] = [doc, n, key, [doc], None, None, None, None]
                continue
            order = np.lexsort((own, f))
            f = f[order]
            ell = choose(f, n, least)
            held = f > 1
            prefix = own[order[: n - least + ell]][held[: n - least + ell]]
            rows[key] = [doc, n, key, [doc], ell, int(held[: n - least + 1].sum()), prefix.view(np.int64).tolist(), own[df[s:e] > 1].tobytes()]
        names = "doc_id n key ids ell base prefix shared"
        return _table([*rows.values()], names, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))

    counted = by_batch.applyInArrow(emit, _SENT).groupBy("part").applyInArrow(answer, _SENT)
    return by_batch.cogroup(counted.groupBy("batch")).applyInArrow(finish, _SET)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of narrow 0/1 matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    tokens = np.intersect1d(flat_a, flat_b)
    ok_a, ok_b = in_sorted(flat_a, tokens), in_sorted(flat_b, tokens)
    row_a, row_b = row_a[ok_a], row_b[ok_b]
    col_a, col_b = np.searchsorted(tokens, flat_a[ok_a]), np.searchsorted(tokens, flat_b[ok_b])
    for at in range(0, len(tokens), width):
        m, k = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        own = (col_a >= at) & (col_a < at + width)
        m[row_a[own], col_a[own] - at] = 1
        own = (col_b >= at) & (col_b < at + width)
        k[row_b[own], col_b[own] - at] = 1
        out += m @ k.T
    return out


def find_links(members: list[tuple], left: list[int], right: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of member numbers that link, between left and right or, if these are the same, inside.
    members: (id, n, l, prefix, tokens that other documents have)."""
    same = left is right
    if len(left) * len(right) <= 400:
        prefix = {k: frozenset(members[k][3].tolist()) for k in {*left, *right}}
        tokens: dict[int, frozenset] = {}
        found = []
        for i, x in enumerate(left):
            for y in right[i + 1 :] if same else right:
                (_, n, ell, *_), (_, m, ell2, *_) = members[x], members[y]
                if num * max(n, m) > den * min(n, m) or len(prefix[x] & prefix[y]) < min(ell, ell2):
                    continue
                for k in (x, y):
                    if k not in tokens:
                        tokens[k] = frozenset(members[k][4].tolist())
                inter = len(tokens[x] & tokens[y])
                if den * inter >= num * (n + m - inter):
                    found.append((x, y))
        return found
    n, m = (np.array([members[k][1] for k in side], np.int64) for side in (left, right))
    ell, ell2 = (np.array([members[k][2] for k in side]) for side in (left, right))
    shared = overlaps([members[k][3] for k in left], [members[k][3] for k in right])
    maybe = (shared >= np.minimum(ell[:, None], ell2[None, :])) & (num * np.maximum(n[:, None], m[None, :]) <= den * np.minimum(n[:, None], m[None, :]))
    if same:
        maybe &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    inter = overlaps([members[left[k]][4] for k in rows], [members[right[k]][4] for k in cols]).astype(np.int64)
    union = n[rows][:, None] + m[cols][None, :] - inter
    i, j = np.nonzero(maybe[np.ix_(rows, cols)] & (den * inter >= num * union))
    return [(left[rows[a]], right[cols[b]]) for a, b in zip(i.tolist(), j.tolist())]


class Forest(dict):
    """Union-find over ids; the least id is the root."""

    def root(self, k: int) -> int:
        while self.setdefault(k, k) != k:
            self[k] = self[self[k]]
            k = self[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(k, self.root(k)) for k in list(self) if self.root(k) != k]


def bitmap(tokens: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmap of a set of n tokens, of which tokens are those that other documents have: sets differ in at
    least as many tokens as their bitmaps of one width do in bits. Narrower bitmaps are folds of it."""
    width = WORDS[0]
    while width < WORDS[1] and width * 128 < n:
        width *= 2
    at = (mix(tokens) % np.uint64(width * 64)).astype(np.int64)
    bits = np.bincount(at, minlength=width * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps folded to a narrower width, a power of two as theirs."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def within_bound(left: list[tuple], right: list[tuple], num: int, den: int) -> np.ndarray:
    """Which pairs of (id, n, number of shared tokens, bitmap) can link by size and by the bitmaps' bound of the overlap."""
    n, m = (np.array([x[1] for x in side], np.int64)[:, None] for side in (left, right))
    s, t = (np.array([x[2] for x in side], np.int64)[:, None] for side in (left, right))
    apart = np.zeros((len(left), len(right)), np.int64)
    widths = [np.array([len(x[3]) for x in side]) for side in (left, right)]
    for v in np.unique(widths[0]).tolist():
        for w in np.unique(widths[1]).tolist():
            i, j = np.flatnonzero(widths[0] == v), np.flatnonzero(widths[1] == w)
            a, b = (fold(np.stack([side[k][3] for k in at]), min(v, w)) for side, at in ((left, i), (right, j)))
            bits = np.zeros((len(i), len(j)), np.int64)
            for k in range(min(v, w)):
                bits += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
            apart[np.ix_(i, j)] = bits
    most = (s + t.T - apart) // 2
    return (num * np.maximum(n, m.T) <= den * np.minimum(n, m.T)) & (den * most >= num * (n + m.T - most))


def spanning_edges(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A forest of the pairs marked in a matrix of left and right rows, which same says are one set; right rows are
    numbered after the left ones. Each row is read once."""
    n, m = near.shape
    if same:
        links = near | near.T
    else:
        links = np.zeros((n + m, n + m), bool)
        links[:n, n:], links[n:, :n] = near, near.T
    left, edges = np.ones(len(links), bool), []
    for k in range(len(links)):
        if not left[k]:
            continue
        left[k] = False
        front = np.array([k])
        while len(front):
            front = np.flatnonzero(links[front].any(0) & left)
            left[front] = False
            edges += [(k, x) for x in front.tolist()]
    return edges


def cells_of(size, least: int):
    """(own block, cells) of a row in a group of that size: one cell, or the pairs of blocks that the own block is in."""
    blocks = F.when(size <= least, 1).otherwise(F.ceil(size / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    return own, F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))


def tasks_for(spark, total: int | None) -> int:
    return max(partitions(spark), int(total or 0) // TASK_BYTES)


def refined(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a forest of the pairs of sets that share a prefix token and are within the bitmaps' bound."""

    def signed(batches):
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                shared = [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()]
                n = b.column(1).to_pylist()
                maps = pa.array([bitmap(x, k).tobytes() for x, k in zip(shared, n)], pa.binary())
                keys = pa.array([p[:k] for p, k in zip(b.column(4).to_pylist(), b.column(2).to_pylist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in shared], pa.int64()), maps, keys], ["doc_id", "n", "s", "map", "keys"])

    spark = sets.sparkSession
    signs = sets.select("doc_id", "n", "base", "shared", "prefix").mapInArrow(signed, "doc_id long, n long, s long, map binary, keys array<long>")
    lists = sets.select(F.explode(F.slice("prefix", 1, F.col("base"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    postings = signs.select("doc_id", "n", "s", "map", F.explode("keys").alias("token")).join(lists, "token")
    own, cells = cells_of(F.col("c"), GROUP)
    total = sets.agg(F.sum(F.col("base") * (F.lit(40) + 8 * F.least(F.greatest(F.col("n") / 64, F.lit(WORDS[0])), F.lit(WORDS[1]))))).first()[0]
    spread = postings.withColumns({"block": own, "cells": cells}).select("doc_id", "n", "s", "map", "token", "block", F.inline("cells"))
    task = F.pmod(F.xxhash64("token", "x", "y"), F.lit(tasks_for(spark, total)))

    def connect(t: pa.Table) -> pa.Table:
        lists: dict[tuple, list[tuple]] = {}
        for token, x, y, block, *rest in zip(*(t.column(c).to_pylist() for c in ("token", "x", "y", "block", "doc_id", "n", "s", "map"))):
            lists.setdefault((token, x, y), []).append((block, *rest))
        forest = Forest()
        for (_, x, y), rows in lists.items():
            if len({forest.root(r[1]) for r in rows}) < 2:
                continue  # all connected already
            sides = [[(doc, n, s, np.frombuffer(m, np.uint64)) for block, doc, n, s, m in rows if block == side] for side in (x, y)]
            if all(sides):
                every = sides[0] if x == y else sides[0] + sides[1]
                for i, j in spanning_edges(within_bound(*sides, num, den), x == y):
                    forest.join(every[i][0], every[j][0])
        return _table(forest.edges(), "a b", (pa.int64(), pa.int64()))

    return spread.withColumn("task", task).groupBy("task").applyInArrow(connect, "a long, b long").distinct()


def placed(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """(sets with component and size: those that must be compared with others of their component; paths to discard)."""
    postings = sets.select("doc_id", F.explode(F.slice("prefix", 1, F.col("base"))).alias("token"))
    pivots = postings.groupBy("token").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = postings.join(pivots, "token").where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    sized = lambda g: g.join(g.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").withColumnRenamed("id", "doc_id")
    groups, paths = components(near)
    groups = sized(groups)
    if not groups.where(F.col("size") > GROUP).isEmpty():
        groups, path = saved(groups)
        paths.append(path)
        wide = sets.join(groups.where(F.col("size") > GROUP).select("doc_id"), "doc_id", "left_semi")
        again, more = components(refined(wide, num, den))
        paths += more
        groups = groups.where(F.col("size") <= GROUP).unionByName(sized(again))
    return sets.join(groups, "doc_id"), paths


def linked(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """((a, b, n): forest edges with n 0, and for each node a = b with n links; paths to discard)."""
    near, paths = placed(sets, num, den)
    own, cells = cells_of(F.col("size"), GROUP)
    celled = near.withColumns({"block": own, "cells": cells})
    spread = celled.select("doc_id", "n", "ell", "prefix", "shared", "component", "block", "size", F.inline("cells"))
    total = sets.agg(F.sum(F.octet_length("shared") + 8 * F.size("prefix"))).first()[0]
    # small groups share tasks of about TASK_BYTES by hash; a pair of blocks of a large one is a task
    task = F.when(F.col("size") <= GROUP, F.pmod(F.xxhash64("component"), F.lit(tasks_for(sets.sparkSession, total)))).otherwise(F.xxhash64("component", "x", "y"))

    def link(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("component", "x", "y", "block", "doc_id", "n", "ell", "prefix", "shared")]
        cells: dict[tuple, list[tuple]] = {}
        for component, x, y, block, *rest in zip(*cols):
            cells.setdefault((component, x, y), []).append((block, *rest))
        out = []
        for (_, x, y), rows in cells.items():
            if len(rows) < 2:
                continue
            members = [(doc, n, ell, np.array(prefix, np.int64).view(np.uint64), np.frombuffer(shared, np.uint64)) for _, doc, n, ell, prefix, shared in rows]
            left = [k for k, r in enumerate(rows) if r[0] == x]
            pairs = find_links(members, left, left if x == y else [k for k, r in enumerate(rows) if r[0] == y], num, den)
            forest, degree = Forest(), {}
            for i, j in pairs:
                a, b = members[i][0], members[j][0]
                if a == b:
                    continue
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                forest.join(a, b)
            out += [(a, b, 0) for a, b in forest.edges()]
            out += [(k, k, n) for k, n in degree.items()]
        return _table(out, "a b n", (pa.int64(), pa.int64(), pa.int64()))

    return spread.withColumn("task", task).groupBy("task").applyInArrow(link, "a long, b long, n long"), paths


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, fold_case: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): links at similarity num / den or more; n_links counts
    the other texts (as sets) that a document's text links with."""
    spark = docs.sparkSession
    rows, rows_path = saved(document_sets(docs, words, num, den, fold_case))
    able = rows.where("prefix is not null")
    reps = able.groupBy("key").agg(F.min("doc_id").alias("rep"))
    sets = able.join(reps, "key").where("doc_id = rep").drop("rep", "ids", "key")
    found, paths = linked(sets, num, den)
    found, found_path = saved(found)
    for p in paths:
        discard(spark, p)
    whole, _ = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    classed = rows.select("n", "key", "ids").join(reps, "key", "left").select("n", "ids", "rep")

    def count(batches):
        for b in batches:
            d, _ = shingle_sets(b.column(1).to_pylist(), words, fold_case)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(d, minlength=b.num_rows).astype(np.int64))], ["doc_id", "n_shingles"])

    labelled = classed.join(whole.withColumnRenamed("id", "rep"), "rep", "left").join(links, "rep", "left")
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(count, "doc_id long, n_shingles long")
    each = labelled.select(F.explode("ids").alias("doc_id"), "n", F.coalesce("component", "rep").alias("component"), "n_links")
    out = each.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def link_report(docs: DataFrame) -> DataFrame:
    """The contract's join: three words, similarity 0.9, A-Z in lower case."""
    return join(docs, words=3, num=90, den=100)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; texts without words and rows without doc_id stay."""
    first = join(docs, words, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
