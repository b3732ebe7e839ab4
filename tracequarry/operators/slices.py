"""Bit-sliced blooms: the quote blooms of blocks of passages turned by a right angle.

A block has a row for each bit that any of its blooms has: one bit of each passage, in 64-bit words, in order of the
block's members, which are in a row of bit -1. A text's trigrams need some of the bits only, so a look-up reads these
rows, of 4096, ands them and has the passages that may hold the text. Nothing that holds it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from .retrieval import bloom_bits

PASSAGE = ["document_id", "revision_sha256", "ordinal"]
#: A passage of a layout, which documents with the same body share.
CUT = ["body_sha256", "chunk_kind", "ordinal"]
#: Passages of a block: 2 MB of blooms.
BLOCK = 4096


def ddl(key: list[str]) -> str:
    """The columns of slices whose members are told by key, two strings and an ordinal."""
    return f"block string, bit int, words array<long>, members array<struct<{key[0]}: string, {key[1]}: string, {key[2]}: int>>"


SLICES = ddl(CUT)


def sliced(blooms: DataFrame, key: list[str] = PASSAGE) -> DataFrame:
    """Slices of blooms (key's columns and bloom), each passage once."""
    member = _member(key)
    schema = pa.schema([("block", pa.string()), ("bit", pa.int32()), ("words", pa.list_(pa.int64())), ("members", pa.list_(member))])

    def turned(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        own = [t.column(c).combine_chunks().cast(member.field(c).type) for c in key]
        block = "/".join(str(c[0].as_py()) for c in own)
        members = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.StructArray.from_arrays(own, key))
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.nulls(1, schema.field("words").type), members], schema=schema)
        bits = np.zeros((-(-t.num_rows // 64) * 64, formats.BLOOM_BITS), np.uint8)
        bits[: t.num_rows] = np.unpackbits(np.frombuffer(b"".join(t.column("bloom").to_pylist()), np.uint8).reshape(t.num_rows, -1), axis=1, bitorder="little")
        words = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<i8")
        used = np.flatnonzero(words.any(axis=1))
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * words.shape[1])
        lists = pa.ListArray.from_arrays(ends, pa.array(words[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(used), pa.string()), pa.array(used.astype(np.int32)), lists, pa.nulls(len(used), members.type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in dealt(batches, BLOCK):
            yield from turned(parts)

    return blooms.select(*key, "bloom").mapInArrow(run, ddl(key))


def dealt(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Blocks of size rows, each as its parts; the last one may have fewer."""
    parts, room = [], size
    for b in batches:
        while b.num_rows:
            part, b = b.slice(0, room), b.slice(room)
            parts.append(part)
            room -= part.num_rows
            if not room:
                yield parts
                parts, room = [], size
    if parts:
        yield parts


def _member(key: list[str]) -> pa.DataType:
    return pa.struct([(key[0], pa.string()), (key[1], pa.string()), (key[2], pa.int32())])


def unsliced(slices: DataFrame) -> DataFrame:
    """(the members' columns, bloom) of slices; a group is a block."""
    key = slices.schema["members"].dataType.elementType.names
    schema = f"{key[0]} string, {key[1]} string, {key[2]} int, bloom binary"

    def run(t: pa.Table) -> pa.Table:
        own = next((m for m in t.column("members") if m.is_valid), pa.scalar([], pa.list_(_member(key)))).values
        rows = t.filter(pa.compute.greater_equal(t.column("bit"), 0)).combine_chunks()
        bits = np.zeros((formats.BLOOM_BITS, -(-len(own) // 64) * 64), np.uint8)
        if rows.num_rows:
            words = rows.column("words").combine_chunks().flatten().to_numpy().astype("<i8").reshape(rows.num_rows, -1)
            bits[rows.column("bit").to_numpy()] = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        blooms = np.packbits(np.ascontiguousarray(bits.T[: len(own)]), axis=1, bitorder="little")
        return pa.table([*(own.field(c) for c in range(len(key))), pa.array([x.tobytes() for x in blooms], pa.binary())], names=[*key, "bloom"])

    return slices.groupBy("block").applyInArrow(run, schema)


def may_hold(slices: DataFrame, texts: list[str]) -> DataFrame:
    """(text and the members' columns) of the passages whose bloom has all bits of a text. Texts of
    fewer than three bytes have no bits and are not answered. Rows of other bits are not read."""
    wanted = [(t, b, len(bits)) for t in texts if (bits := bloom_bits(t)) for b in bits]
    asked = slices.sparkSession.createDataFrame(wanted, "text string, bit int, need int")
    bits = sorted({b for _, b, _ in wanted})
    held = slices.where(F.col("bit").isin(bits)).select("block", "bit", F.posexplode("words").alias("word", "value"))
    every = held.join(F.broadcast(asked), "bit").groupBy("text", "block", "word").agg(F.expr("bit_and(value)").alias("value"), F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("value", k) == 1)).alias("place")
    slots = every.where("n = need AND value <> 0").select("text", "block", "word", place)
    members = slices.where("bit = -1").select("block", "members")
    return slots.join(members, "block").select("text", F.element_at("members", F.col("word") * 64 + F.col("place") + 1).alias("m")).select("text", "m.*")
