"""SentencePiece encoding and decoding in one pass of an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position it follows the output links, longest piece first,
and each piece that ends there relaxes the position's best score. Unigram models keep the highest sum
of piece scores over all segmentations. A BPE model's own segmentation is not the one of the highest
sum over all, so for such a file the sum is maximised over the stable segmentations: those in which
the merges of each two adjacent pieces' joint text give just these two pieces. The model's own one is
stable, and a prefix has only one stable segmentation, so the best score's path is the model's: the
best way to a position is the only way, and no later piece can call for another. Characters outside
the vocabulary become byte pieces.

Spaces are written as U+2581 and a space is put before a text, as the model file says. No piece has
that mark behind another character, so texts fall into parts that are segmented apart and kept in a
bounded memo. Model files with a character map are refused. Defined results: null and empty texts
have no ids; decoding gives the text back exactly but for U+2581 itself, which reads as a space;
rows that repeat a doc_id are encoded each; of ways of equal score the one with the longest last piece
is taken; very long texts are read part by part, in slices of bounded bytes; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Piece types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts and pairs kept in a worker.
KEPT = 400_000
NEVER = float("-inf")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints, floats or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


def read_model(data: bytes) -> tuple[int, bool, list[tuple[str, float, int]]]:
    """(model type, whether a space goes before a text, pieces as (text, score, type))."""
    kind, prefix, pieces = UNIGRAM, True, []
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode("utf-8"), float(f.get(2, 0.0)), int(f.get(3, NORMAL))))
        elif number == 2:
            kind = int(dict(_fields(value)).get(3, UNIGRAM))
        elif number == 3:
            f = dict(_fields(value))
            prefix = bool(f.get(3, 1))
            if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("only model files that leave the text as it is are supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is not supported")
    return kind, prefix, pieces


class Codec:
    """Encoder and decoder for one model."""

    def __init__(self, kind: int, prefix: bool, pieces: list[tuple[str, float, int]]):
        self.kind, self.prefix = kind, prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.text = [p for p, _, _ in pieces]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.low = min(self.score[i] for i in self.ids.values()) - 10.0
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        lines = not any("\n" in p for p in self.ids)
        self.parts = re.compile("\n| *[^ \n]+| +" if lines else " *[^ ]+| +", re.S).findall if self.splits else lambda t: [t]
        self.build()
        self.memo = Memo(self.pack)
        self.pairs: dict[int, bool] = {}

    def build(self) -> None:
        """States by number: children, failure links, and the pieces that end there, longest first."""
        children: list[dict[str, int]] = [{}]
        own = [-1]
        for piece, i in self.ids.items():
            s = 0
            for c in piece:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    own.append(-1)
                s = children[s][c]
            own[s] = i
        fail, out = [0] * len(children), [()] * len(children)
        queue = [*children[0].values()]
        for s in queue:
            out[s] = out[fail[s]]  # the output link's pieces; the state's own is longer
            if own[s] >= 0:
                out[s] = ((own[s], len(self.text[own[s]])), *out[s])
            for c, t in children[s].items():
                f = fail[s]
                while f and c not in children[f]:
                    f = fail[f]
                fail[t] = children[f].get(c, 0)
                queue.append(t)
        self.children, self.fail, self.out = children, fail, out

    def merge(self, text: str) -> list[int]:
        """BPE by merging: the adjacent pair whose joint piece scores highest, leftmost first."""
        parts = list(text)
        ids, score = self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def stable(self, pair: int) -> bool:
        """Whether the merges of two pieces' joint text give the pieces; pair is first * 2**20 + second."""
        a, b = pair >> 20, pair & 0xFFFFF
        if len(self.pairs) > KEPT:
            self.pairs.clear()
        found = self.pairs[pair] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return found

    def segment(self, text: str) -> list[int]:
        """Piece ids of a text with MARK for spaces; -1 - code point for characters without a piece."""
        children, fail, out = self.children, self.fail, self.out
        n, s = len(text), 0
        last = [0] * (n + 1)  # the piece that ends here, and its length
        size = [0] * (n + 1)
        best = [0.0] * (n + 1)
        pairs, stable, score, low, ids, bpe = self.pairs.get, self.stable, self.score, self.low, self.ids, self.kind == BPE
        for j, c in enumerate(text, 1):
            t = children[s].get(c)
            while t is None:
                if not s:
                    t = 0
                    break
                s = fail[s]
                t = children[s].get(c)
            s = t
            if bpe and c in ids:
                top = NEVER
            else:
                top, last[j], size[j] = best[j - 1] + low, -1 - ord(c), 1
            for x, k in out[s]:
                i = j - k
                if (v := best[i] + score[x]) > top or (v == top and last[j] < 0):
                    if bpe and i and (a := last[i]) >= 0:
                        ok = pairs(a << 20 | x)
                        if not (stable(a << 20 | x) if ok is None else ok):
                            continue
                    top, last[j], size[j] = v, x, k
                    if bpe:
                        break  # the only stable way
            best[j] = top
        path = []
        while n:
            path.append(last[n])
            n -= size[n] or n  # a way to the end always exists
        return path[::-1]

    def pack(self, part: str) -> bytes:
        ids = array("i")
        for i in self.segment(part.replace(" ", MARK)):
            if i >= 0:
                ids.append(i)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in chr(-1 - i).encode("utf-8", "replace"))
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        whole = (" " + text if self.prefix else text).replace(MARK, " ")
        return b"".join(map(self.memo.__getitem__, self.parts(whole)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Memo(dict):
    """part -> packed ids, of the last KEPT parts or so: what an older generation has is taken over
    when it is asked for again. Long parts are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= 64:
            if len(self) > KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found


def worker_codec(key: str, model) -> Codec:
    """One codec for each model and worker process, whatever task asks."""
    store = sys.modules.setdefault("_piece_codecs", types.ModuleType("_piece_codecs"))
    if key not in store.__dict__:
        store.__dict__[key] = Codec(*model)
    return store.__dict__[key]


def load(spark: SparkSession, path: str = DEFAULT_MODEL):
    """The parsed model file. A path with a scheme is read by Spark from its store, one without is a file of the
    driver's, whose parsed pieces are then sent to the executors."""
    from hashlib import sha256

    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    return sha256(data).hexdigest(), read_model(data)


def encode(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): round_trip tells whether the ids decode to the text."""
    key, model = load(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the model file

    def run(batches):
        codec = worker_codec(key, shared.value)
        for part in sliced(batches, 1):
            texts = part.column(1).to_pylist()
            packed = [codec.encode_packed(t) for t in texts]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            values = np.frombuffer(b"".join(packed), np.int32)
            ends = np.concatenate([[0], sizes.cumsum()])
            same = [codec.decode(values[s:e].tolist()) == (t or "").replace(MARK, " ") for t, s, e in zip(texts, ends, ends[1:])]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    key, model = load(encoded.sparkSession, path)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = worker_codec(key, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_report(docs: DataFrame) -> DataFrame:
    return encode(docs).select("doc_id", "n_tokens", "ids", F.col("round_trip"))
