"""Hashes and identities: body and revision hashes as columns, fingerprints, blooms, ids."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import formats


def body_sha256(body: Column) -> Column:
    """Lower-case hex SHA-256 of a binary column."""
    return F.sha2(body, 256)


def _frame(tag: int, value: Column) -> Column:
    size = F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0")
    return F.concat(F.lit(bytes([tag])), F.unhex(size), value)


def revision_sha256(body: Column, source_uri: Column, title: Column, metadata_json: Column, updated_utc: Column) -> Column:
    """Hash of a document revision: length-framed body, URI, title, canonical metadata and the UTC
    timestamp as a JSON value (null: the JSON null)."""
    stamp = F.coalesce(F.concat(F.lit('"'), updated_utc, F.lit('"')), F.lit("null"))
    parts = [body, *(c.cast("binary") for c in (source_uri, title, metadata_json, stamp))]
    return F.sha2(F.concat(F.lit(formats.SNAPSHOT_DOMAIN), *(_frame(k, p) for k, p in enumerate(parts, 1))), 256)


def canonical_json(value: dict) -> str:
    """RFC 8785 form of an object whose numbers are integers: keys in UTF-16 order, no white space."""

    def order(x):
        if isinstance(x, dict):
            return {k: order(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be"))}
        if isinstance(x, list):
            return [order(y) for y in x]
        if isinstance(x, float):
            raise ValueError("only integer numbers have a canonical form here")
        return x

    if not isinstance(value, dict):
        raise ValueError("metadata must be an object")
    return json.dumps(order(value), separators=(",", ":"), ensure_ascii=False)


def utc_timestamp(value: str | None) -> str | None:
    """RFC 3339 in UTC with the fraction's trailing zeros removed; the digits of the fraction are kept."""
    if value is None:
        return None
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)", value)
    if not m:
        raise ValueError(f"not an RFC 3339 timestamp: {value!r}")
    at = datetime.fromisoformat(m[1].upper() + ("+00:00" if m[3] in "Zz" else m[3])).astimezone(timezone.utc)
    fraction = (m[2] or "").rstrip("0")
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{fraction}" if fraction else "") + "Z"


def format_mtime(ns: int) -> str:
    """RFC 3339 of nanoseconds since the epoch."""
    seconds, rest = divmod(ns, 10**9)
    stamp = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    fraction = f"{rest:09d}".rstrip("0")
    return f"{stamp}.{fraction}Z" if fraction else f"{stamp}Z"


def pipeline_fingerprint() -> str:
    return hashlib.sha256(formats.pipeline_descriptor().encode()).hexdigest()


def chunker_fingerprint(kind: str) -> str:
    return hashlib.sha256(formats.LAYOUT_DESCRIPTOR.format(kind=kind).encode()).hexdigest()


def kind_of_fingerprint(fingerprint: str) -> str | None:
    return next((k for k in dict.fromkeys(formats.EXTENSIONS.values()) if chunker_fingerprint(k) == fingerprint), None)


def source_uri(key: bytes) -> str:
    """repo:// and the key with everything but unreserved characters and slashes in upper-case percent form."""
    return "repo://" + quote(key, safe="/-._~")


def display_key(key: bytes) -> str:
    """A key for people: printable ASCII, backslashes doubled, other bytes as \\xHH."""
    return "".join("\\\\" if b == 92 else chr(b) if 32 <= b < 127 else f"\\x{b:02X}" for b in key)


def display_title(key: bytes) -> str:
    return display_key(key.rsplit(b"/", 1)[-1])


def name_uuid(*parts: str) -> str:
    """A version 5 UUID of names, the same at every build."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(parts)))


def name_uuid_column(text: Column) -> Column:
    """Column form of a name-based UUID: SHA-1 shape bits set on the hash of the text."""
    h = F.sha1(text.cast("binary"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def derive_source_id(index_id: str, project_id: str) -> str:
    raw = bytearray(hashlib.sha256(formats.SOURCE_ID_DOMAIN + uuid.UUID(index_id).bytes + uuid.UUID(project_id).bytes).digest()[:16])
    raw[6] = raw[6] & 0x0F | 0x50
    raw[8] = raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))


def bloom_positions(trigram: bytes) -> list[int]:
    digest = hashlib.sha256(trigram).digest()
    h1, h2 = int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")
    return [(h1 + i * h2) % 2**32 % formats.BLOOM_BITS for i in range(formats.BLOOM_HASHES)]


def quote_bloom(content: bytes, known: dict[bytes, int] | None = None) -> bytes:
    """Bloom of a text's byte trigrams; known keeps their bits from one text to the next."""
    known = {} if known is None else known
    bits = 0
    for t in {content[i : i + 3] for i in range(len(content) - 2)}:
        mask = known.get(t)
        if mask is None:
            mask = 0
            for p in bloom_positions(t):
                mask |= 1 << p
            known[t] = mask
        bits |= mask
    return bits.to_bytes(formats.BLOOM_BITS // 8, "little")


def bloom_may_contain(bloom: bytes, quoted: bytes) -> bool:
    bits = int.from_bytes(bloom, "little")
    return all(bits >> p & 1 for i in range(len(quoted) - 2) for p in bloom_positions(quoted[i : i + 3]))


class Trigrams:
    """Bloom positions of trigrams, each hashed once while at most KEPT are kept."""

    KEPT = 1 << 20

    def __init__(self):
        self.places = np.zeros(1 << 24, np.int32)  # a trigram's row of bits, 0 if it has none; memory is taken where it is written
        self.bits = np.zeros((1, formats.BLOOM_HASHES), np.int32)

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Rows of positions of codes in order."""
        places = self.places[codes]
        if not places.all():
            new = np.unique(codes[places == 0])
            if len(self.bits) + len(new) > self.KEPT:
                self.__init__()
                new = np.unique(codes)
            made = np.array([bloom_positions(int(c).to_bytes(3, "big")) for c in new.tolist()], np.int32)
            self.places[new] = len(self.bits) + np.arange(len(new), dtype=np.int32)
            self.bits = np.concatenate([self.bits, made])
            places = self.places[codes]
        return self.bits[places]


def quote_blooms(texts: list[bytes], trigrams: Trigrams) -> list[bytes]:
    """quote_bloom of texts, together."""
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.int32)
    owners = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    marks = np.zeros(len(texts) * formats.BLOOM_BITS, bool)
    if len(b) > 2:
        whole = owners[:-2] == owners[2:]  # not from the end of one text into the next
        codes, first = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[whole], owners[:-2][whole] * formats.BLOOM_BITS
        for bit in trigrams.positions(codes).T:
            marks[first + bit] = True
    return [m.tobytes() for m in np.packbits(marks.reshape(len(texts), formats.BLOOM_BITS), axis=1, bitorder="little")]


@F.pandas_udf(BinaryType())
def quote_bloom_column(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bloom of a string column's UTF-8 bytes."""
    trigrams = Trigrams()
    for part in content:
        texts = [(t or "").encode() for t in part]
        yield pd.Series([x for at in range(0, len(texts), 256) for x in quote_blooms(texts[at : at + 256], trigrams)], index=part.index, dtype=object)


def citation(index_id: Column, source_id: Column, document_id: Column, revision: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(formats.CITATION_PREFIX), index_id, F.lit("/"), source_id, F.lit("/"), document_id, F.lit("?rev="), revision, F.lit("#bytes="), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_citation(text: str) -> dict:
    """The parts of a citation; anything but the canonical form is refused."""
    one = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    number = r"(0|[1-9][0-9]*)"
    m = re.fullmatch(f"{re.escape(formats.CITATION_PREFIX)}{one}/{one}/{one}\\?rev=([0-9a-f]{{64}})#bytes={number}-{number}", text)
    if not m or not int(m[5]) <= int(m[6]) < 2**64:
        raise ValueError("not a citation")
    return {"index_id": m[1], "source_id": m[2], "document_id": m[3], "revision": m[4], "start": int(m[5]), "end": int(m[6])}
