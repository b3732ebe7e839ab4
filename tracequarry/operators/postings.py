"""Postings by blocks of passages: a row for each term of a block, with the places of the passages that hold it.

A block's members (who they are, where they start and how many tokens they have) are in one row without a term, and a posting is
a place among them and a count. So identities are stored once for each passage, not for each of its terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import PASSAGE, dealt

MEMBER = [*PASSAGE, "start_byte", "len"]
POSTINGS = "term string, block string, slots array<smallint>, counts array<int>, members array<struct<document_id: string, revision_sha256: string, ordinal: int, start_byte: long, len: int>>"
#: Passages of a block; a slot is a smallint.
BLOCK = 4096
#: A digest's numbers, and of so many blocks (160 KB each) a task holds them at once.
SUMS, HELD = 5, 64
DIGESTS = "document_id string, revision_sha256 string, ordinal int, start_byte long, len int, digest string"
_MEMBER = pa.struct([("document_id", pa.string()), ("revision_sha256", pa.string()), ("ordinal", pa.int32()), ("start_byte", pa.int64()), ("len", pa.int32())])
_SCHEMA = pa.schema([("term", pa.string()), ("block", pa.string()), ("slots", pa.list_(pa.int16())), ("counts", pa.list_(pa.int32())), ("members", pa.list_(_MEMBER))])


def posted(passages: DataFrame) -> DataFrame:
    """POSTINGS of passages (MEMBER's columns and tokens, an array), each passage once. A block's rows come from one task."""

    def turned(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        own = [t.column(c).combine_chunks().cast(_MEMBER.field(c).type) for c in MEMBER]
        block = "/".join(str(c[0].as_py()) for c in own[: len(PASSAGE)])
        members = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.StructArray.from_arrays(own, MEMBER))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block]), pa.nulls(1, _SCHEMA.field("slots").type), pa.nulls(1, _SCHEMA.field("counts").type), members], schema=_SCHEMA)
        lists = t.column("tokens").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return
        pair, count = np.unique(coded.indices.to_numpy().astype(np.int64) * BLOCK + lists.value_parent_indices().to_numpy(), return_counts=True)
        first = np.flatnonzero(np.diff(pair // BLOCK, prepend=-1))
        ends = pa.array(np.append(first, len(pair)).astype(np.int32))
        slots, counts = (pa.ListArray.from_arrays(ends, pa.array(x.astype(k))) for x, k in ((pair % BLOCK, np.int16), (count, np.int32)))
        n = len(coded.dictionary)
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array([block] * n), slots, counts, pa.nulls(n, _SCHEMA.field("members").type)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in dealt(batches, BLOCK):
            yield from turned(parts)

    return passages.select(*MEMBER, "tokens").mapInArrow(run, POSTINGS)


def postings_of(blocks: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, f and MEMBER's columns) of terms, or of all. Rows of other terms are not read."""
    rows = blocks.where("term IS NOT NULL" if terms is None else F.col("term").isin(terms))  # pushed to the scan; files are sorted by term
    held = rows.select("term", "block", F.inline(F.arrays_zip("slots", "counts"))).select("term", "block", F.col("slots").cast("int").alias("slot"), F.col("counts").cast("long").alias("f"))
    return held.join(members(blocks), ["block", "slot"]).select("term", "f", *MEMBER)


def postings_among(blocks: DataFrame, passages: DataFrame) -> DataFrame:
    """(term, f and the columns of passages) of all postings of passages (document_id, revision_sha256 and others, each version once). A group is
    a block: its rows are dealt out as they are, and only postings of the passages become rows."""
    live = members(blocks).select(F.col("block").alias("own"), "slot", *PASSAGE[:2]).join(passages, PASSAGE[:2])
    names = passages.columns
    schema = ", ".join(["term string", "f bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in live.select(names).schema)])

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows, own = rows.combine_chunks(), own.combine_chunks()
        place = np.full(1 << 15, -1)
        place[own.column("slot").to_numpy()] = np.arange(own.num_rows)
        slots, counts = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], _SCHEMA.field(c).type) for c in ("slots", "counts"))
        at = place[slots.flatten().to_numpy()]
        keep = np.flatnonzero(at >= 0)
        of, f = slots.value_parent_indices().to_numpy()[keep], counts.flatten().to_numpy()[keep].astype(np.int64)
        return pa.table([rows.column("term").take(pa.array(of)), pa.array(f), *(own.column(c).take(pa.array(at[keep])) for c in names)], names=["term", "f", *names])

    held = blocks.where("term IS NOT NULL").select("block", "term", "slots", "counts")
    return held.groupBy("block").cogroup(live.groupBy("own")).applyInArrow(run, schema)


def members(blocks: DataFrame) -> DataFrame:
    """(block, slot and MEMBER's columns) of all blocks."""
    return blocks.where("term IS NULL").select("block", F.posexplode("members").alias("slot", "m")).select("block", "slot", "m.*")


def _hashes(terms: pa.Array) -> np.ndarray:
    """Four numbers for each term, of its hash, and a one."""
    found = np.ones((len(terms), SUMS), np.uint64)
    found[:, :-1] = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in terms.to_pylist()), "<u8").reshape(len(terms), -1)
    return found


def digests(passages: DataFrame) -> DataFrame:
    """(MEMBER's columns, digest) of passages with their tokens: the sums of the tokens' hashes, whatever their order, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists = part.column("tokens")
                coded = lists.flatten().dictionary_encode()
                ends = np.cumsum(lists.value_lengths().to_numpy())
                so_far = np.zeros((len(coded) + 1, SUMS), np.uint64)
                np.cumsum(_hashes(coded.dictionary)[coded.indices.to_numpy()], axis=0, out=so_far[1:])  # modulo 2^64
                sums = so_far[ends] - so_far[np.append(0, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(MEMBER)], pa.array([x.tobytes().hex() for x in sums], pa.string())], names=[*MEMBER, "digest"])

    return passages.select(*MEMBER, "tokens").mapInArrow(run, DIGESTS)


def stored_digests(blocks: DataFrame) -> DataFrame:
    """digests() of what blocks hold. A task adds its rows' hashes up where they are, and only these sums are dealt out by block. A block that can't
    be read as one has a row without an identity, and a passage whose counts do not add up to its tokens has no digest."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray | None] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([b"" if x is None else x.tobytes() for x in held.values()], pa.binary())], names=["block", "sums"])

        for rows in batches:
            coded, names = rows.column("term").dictionary_encode(), rows.column("block").dictionary_encode()
            hashes, of_block = _hashes(coded.dictionary)[coded.indices.to_numpy()], names.indices.to_numpy()
            for k, block in enumerate(names.dictionary.to_pylist()):
                mine = np.flatnonzero(of_block == k)
                lists, counts = (rows.column(c).take(pa.array(mine)) for c in ("slots", "counts"))
                slot, count = (x.flatten().to_numpy().astype(np.int64) for x in (lists, counts))
                whole = not (lists.null_count or counts.null_count) and lists.value_lengths().equals(counts.value_lengths()) and (not len(slot) or (0 <= slot.min() and slot.max() < BLOCK and count.min() > 0))
                sums = held.setdefault(block, np.zeros((SUMS, BLOCK), np.uint64))
                if not whole or sums is None:
                    held[block] = None
                    continue
                each = hashes[mine[lists.value_parent_indices().to_numpy()]] * count.astype(np.uint64)[:, None]
                for lane in range(SUMS):
                    np.add.at(sums[lane], slot, each[:, lane])
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    def run(t: pa.Table) -> pa.Table:
        own = [m for members in t.column("members").to_pylist() for m in members or ()]
        parts = [x for x in t.column("sums").to_pylist() if x is not None]
        found: list[str | None] = [None] * len(own)
        total = np.zeros((SUMS, BLOCK), np.uint64)
        for x in parts:
            total += np.frombuffer(x, np.uint64).reshape(SUMS, BLOCK) if x else np.uint64(0)
        if not own or b"" in parts or len(own) > BLOCK or total[:, len(own) :].any():
            own, found = [*own, dict.fromkeys(MEMBER)], [*found, None]
        else:
            found = [x.tobytes().hex() if x[-1] == m["len"] else None for x, m in zip(np.ascontiguousarray(total.T), own)]
        return pa.table([pa.array([m[c] for m in own], _MEMBER.field(c).type) for c in MEMBER] + [pa.array(found, pa.string())], names=[*MEMBER, "digest"])

    sums = blocks.where("term IS NOT NULL").select("term", "block", "slots", "counts").mapInArrow(summed, "block string, sums binary")
    both = blocks.where("term IS NULL").select("block", "members").unionByName(sums, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(run, DIGESTS)
