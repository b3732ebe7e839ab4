"""Passages: a document's bytes cut at preferred boundaries, with byte and line spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import formats

_BLANK = re.compile(rb"\s*", re.S)
_SENTENCE = re.compile(rb"[.?!](?=[ \t\n\x0c\r]|\Z)")
_LINE = re.compile(rb"[^\n]*\n?")
#: Boundary lists of each kind, by priority; the other kinds are code.
PRIORITIES = {
    "markdown": ("heading", "fence", "paragraph", "sentence"),
    "plain-text": ("paragraph", "sentence", "line"),
    "shell": ("paragraph", "line"),
    "sql": ("paragraph", "line"),
}
CODE = ("declaration", "paragraph", "line")
SCHEMA = "ordinal int, start_byte long, end_byte long, start_line long, end_line long, body_text string, content_sha256 string"


def _continues(data: bytes, at: int) -> bool:
    return at < len(data) and data[at] & 0xC0 == 0x80


def _floor(data: bytes, at: int, low: int) -> int:
    while at > low and _continues(data, at):
        at -= 1
    return at


def _ceil(data: bytes, at: int, high: int) -> int:
    while at < high and _continues(data, at):
        at += 1
    return at


class _Window:
    """Boundary candidates between start and end; its lines begin with the one that start is in."""

    def __init__(self, data: bytes, start: int, end: int, kind: str):
        self.data, self.start, self.end, self.kind = data, start, end, kind
        at = data.rfind(b"\n", 0, start) + 1
        self.lines = []
        for m in _LINE.finditer(data, at, end):
            if m.start() < end:
                self.lines.append((m.start(), m[0].removesuffix(b"\n").removesuffix(b"\r") if m[0].endswith(b"\n") else m[0].removesuffix(b"\r")))

    def blank(self, line: bytes) -> bool:
        return not line.decode("utf-8", "replace").strip()

    def line(self):
        return [s for s, _ in self.lines if s > self.start]

    def paragraph(self):
        marks = [self.blank(x) for _, x in self.lines]
        return [s for (s, _), before, now in zip(self.lines[1:], marks, marks[1:]) if before and not now]

    def sentence(self):
        found = [m.end() for m in _SENTENCE.finditer(self.data, self.start, self.end)]
        return found

    def heading(self):
        return [s for s, x in self.lines if x.decode("utf-8", "replace").lstrip().startswith("#")]

    def fence(self):
        return [s for s, x in self.lines if x.decode("utf-8", "replace").lstrip().startswith(("```", "~~~"))]

    def declaration(self):
        starts = tuple(formats.DECLARATIONS[self.kind])
        texts = ((s, x.decode("utf-8", "replace")) for s, x in self.lines)
        return [s for s, t in texts if t[:1] and not t[0].isspace() and t.rstrip().startswith(starts)]


def cut(data: bytes, kind: str, target: int = formats.TARGET_BYTES, longest: int = formats.MAX_BYTES, overlap: int = formats.OVERLAP_BYTES) -> list[tuple[int, int]]:
    """Byte spans of a text's passages. A byte-order mark is left out; the text must be UTF-8 without NUL."""
    data.decode("utf-8")
    if b"\0" in data:
        raise ValueError("NUL in content")
    start, spans = (3 if data.startswith(b"\xef\xbb\xbf") else 0), []
    while start < len(data):
        hard = _floor(data, min(start + longest, len(data)), start)
        end = hard if len(data) - start <= target else _preferred(data, kind, start, _floor(data, min(start + target, hard), start), hard)
        spans.append((start, end))
        if end == len(data):
            break
        after = _ceil(data, max(end - overlap, 0), end)
        start = after if after > start else end
    return spans


def _preferred(data: bytes, kind: str, start: int, target: int, hard: int) -> int:
    least = _ceil(data, start + (target - start) // 2, target)
    window = _Window(data, start, hard, kind)
    for name in PRIORITIES.get(kind, CODE):
        places = [p for p in getattr(window, name)() if least <= p <= hard]
        before = [p for p in places if p <= target]
        if places:
            return before[-1] if before else places[0]
    return hard


def passages(data: bytes, kind: str) -> list[tuple]:
    """(ordinal, start, end, first line, last line, text, SHA-256) of each passage."""
    newlines = [m.start() for m in re.finditer(b"\n", data)]
    out = []
    for k, (s, e) in enumerate(cut(data, kind)):
        part = data[s:e]
        out.append((k, s, e, 1 + bisect_left(newlines, s), 1 + bisect_left(newlines, e - 1), part.decode("utf-8"), hashlib.sha256(part).hexdigest()))
    return out


def chunk(docs: DataFrame, key: list[str], body: str = "body", kind: str = "chunk_kind") -> DataFrame:
    """Rows of passages for rows of documents with key columns, a binary body and a kind. Bodies that
    are no UTF-8 or hold NUL raise an error; null bodies have no passages."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    picked = docs.select(*key, body, kind)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*key).schema) + ", " + SCHEMA
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, origin = [], []
                for i, (data, k) in enumerate(zip(part.column(len(key)).to_pylist(), part.column(len(key) + 1).to_pylist())):
                    own = passages(data, k) if data is not None else []
                    rows += own
                    origin += [i] * len(own)
                cols = list(zip(*rows)) or [()] * len(names)
                keys = [part.column(i).take(pa.array(origin, pa.int64())) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, t in zip(cols, types)], key + names)

    return picked.mapInArrow(run, schema)
