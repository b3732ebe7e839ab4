"""Text functions: tokens, identifier literals, query parsing."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats

TOKEN = r"[\p{L}\p{N}\p{Co}_\-.:/][\p{L}\p{N}\p{Co}\u0300-\u0331_\-.:/]*"
IDENTIFIER = r"[A-Za-z0-9_.:/-]+"
#: A whole run of these with a letter or digit and a mark; plain words are passed over.
MARKED = r"(?<![A-Za-z0-9_.:/-])(?:[A-Za-z0-9]++[_.:/-]|[_.:/-]++[A-Za-z0-9])[A-Za-z0-9_.:/-]*+"


def tokens(text: Column) -> Column:
    """Full-text tokens: case-folded runs of letters, numbers, private-use characters and _-.:/."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def identifier_literals(text: Column) -> Column:
    """Distinct ASCII identifier runs in order: 2 to 128 bytes with a letter or digit and a mark, at most 64."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKED), F.lit(0))
    good = F.filter(runs, lambda x: (F.length(x) >= formats.LITERAL_MIN) & (F.length(x) <= formats.LITERAL_MAX))
    return F.slice(F.array_distinct(good), 1, formats.LITERALS)


def passage_literals(title: Column, uri: Column, body: Column) -> Column:
    """(literal, field) of title, then URI, then body, 64 together."""
    of = lambda c, name: F.transform(identifier_literals(c), lambda x: F.struct(x.alias("literal"), F.lit(name).alias("field")))
    return F.slice(F.concat(of(title, "title"), of(uri, "source_uri"), of(body, "body")), 1, formats.LITERALS)


class QueryError(ValueError):
    """A query that the parser refuses; code names why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Query:
    original: str
    atoms: tuple[tuple[str, str], ...]  # (text, quoted or identifier), by first place
    spans: tuple[tuple[str, int, int], ...]  # quoted text with its byte span

    @property
    def terms(self) -> list[str] | None:
        return lexical_terms(self.original)


def _alphanumeric(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or (c.isalpha() and not c.isspace())


def parse_query(text: str) -> Query:
    """Quoted spans and identifiers of a query, in order of place, each text once."""
    data = text.encode("utf-8")
    for code, wrong in (("too_long", len(data) > formats.QUERY_BYTES), ("nul", b"\0" in data), ("blank", not text.strip())):
        if wrong:
            raise QueryError(code)
    marks = [i for i, b in enumerate(data) if b == 0x22]
    atoms, spans = [], []
    for a, b in zip(marks[::2], marks[1::2]):
        quoted = data[a + 1 : b].decode("utf-8")
        _check_quoted(quoted, b - a - 1)
        spans.append((quoted, a + 1, b))
        atoms.append((a + 1, quoted, "quoted"))
    if len(marks) % 2:
        raise QueryError("unmatched_quote")
    bare = bytearray(data)
    for _, a, b in spans:
        bare[a - 1 : b + 1] = b'"' * (b - a + 2)
    for m in re.finditer(IDENTIFIER.encode(), bytes(bare)):
        if re.search(rb"[A-Za-z0-9]", m[0]) and re.search(rb"[_.:/-]", m[0]):
            if len(m[0]) > formats.ATOM_BYTES:
                raise QueryError("atom_too_long")
            atoms.append((m.start(), m[0].decode(), "identifier"))
    first: dict[str, str] = {}
    for _, atom, kind in sorted(atoms):
        first.setdefault(atom, kind)
    if len(first) > formats.ATOMS:
        raise QueryError("too_many_atoms")
    return Query(text, tuple(first.items()), tuple(spans))


def _check_quoted(quoted: str, size: int) -> None:
    if not quoted.strip():
        raise QueryError("empty_quote")
    if size > formats.ATOM_BYTES:
        raise QueryError("atom_too_long")
    if size < 3 and not any(_alphanumeric(c) or c.isspace() for c in quoted):
        raise QueryError("punctuation_quote_too_short")
    if size < 2:
        raise QueryError("atom_too_short")


def lexical_terms(text: str) -> list[str] | None:
    """Query tokens that must all match, each distinct spelling once; None if there is none."""
    runs, current = [], []
    for c in [*text, " "]:
        if _alphanumeric(c) or c in "_-.:/":
            current.append(c)
            continue
        run = "".join(current)
        current = []
        if run and any(map(_alphanumeric, run)) and run not in runs:
            runs.append(run)
    return runs or None


def fts_expression(text: str) -> str | None:
    terms = lexical_terms(text)
    return " AND ".join(f'"{t}"' for t in terms) if terms else None


def phrase_quote(text: str) -> bool:
    """Whether a quoted text can be looked up as a phrase of tokens."""
    return bool(re.fullmatch(r"[A-Za-z0-9 \t\n\x0c\r_.:/-]*", text) and re.search("[A-Za-z0-9]", text))


def fold_token(token: str) -> list[str]:
    """The index tokens that a query token stands for."""
    import regex

    return regex.findall(TOKEN, token.lower())


def valid_slug(text: str) -> bool:
    return bool(re.fullmatch("[a-z0-9_-]{1,64}", text))


def slugify(name: str) -> str:
    """A slug of a path's last segment."""
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).lstrip("-")[:64].rstrip("-")
    return slug or "index"


def slug_with_suffix(slug: str, n: int) -> str:
    tail = f"-{n}"
    return slug[: 64 - len(tail)].rstrip("-") + tail


def escape_terminal(data: bytes) -> str:
    """Text that is safe to print: control characters and bytes that are no UTF-8 in escaped form."""
    out = []
    for c in data.decode("utf-8", "surrogateescape"):
        if 0xDC80 <= ord(c) <= 0xDCFF:
            out.append(f"\\x{ord(c) - 0xDC00:02X}")
        elif c == "\\":
            out.append("\\\\")
        elif unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp"):
            out.append(f"\\u{{{ord(c):X}}}")
        else:
            out.append(c)
    return "".join(out)


def heading_queries(body: str) -> list[str]:
    """Suggested queries of a text: its Markdown headings of 2 to 256 printable ASCII bytes."""
    found = re.findall(r"^#{1,6} +(.*?)\s*$", body, re.M)
    return list(dict.fromkeys(h for h in found if re.fullmatch(r"[\x20-\x7e]{2,256}", h)))
