"""HTML extraction with a suffix array over each host's pages.

A page is parsed to blocks. Structure decides what it can: scripts, styles, menus, headers, footers,
sidebars, notices, adverts, forms and comments go; what stands in an article or main element stays.
The token streams of the pages of a host are concatenated, and the suffix array, sorted to
SPAN tokens by prefix doubling, gives the substrings of at least SPAN tokens that occur on several
distinct pages. They cover boilerplate: covered runs of blocks without an article around them are
removed and the unique runs kept.

Parsed pages are dealt into batches of bounded size by hash of page_id, so that no task gets a whole
large host. A batch's suffix array gives its runs of SPAN tokens and each run's distinct pages; the
counts go, packed (see packed.py), to partitions of the hash space, which add them up for the whole
host and answer each batch with its runs on PAGES pages or more. Where the pages are dealt changes
nothing. Hosts whose pages all have no block outside article and main send nothing, as no run can
remove a word there. Equality of runs and of hosts between batches is that of 64-bit hashes.

Defined results: null html gives the empty text; a null or odd url is a host of its own name; repeated page rows are kept, and
equal page_ids count as one page; very long pages are parsed whole, in slices of bounded bytes; a run on exactly PAGES pages goes;
extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, sliced
from .packed import BATCH_BYTES, Hasher, in_sorted, mix, sizes, split_by_part

SPAN = 16  # a power of two
PAGES = 3

#: Elements, by what they do to a page's text.
RAW = frozenset("script style noscript template textarea select svg iframe object math canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
GONE = frozenset("nav header footer aside form head menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("main article post story entry".split())
_GONE_NAME = re.compile(r"(?:ads?|advert\w*|sponsor\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|promo\w*|related|share|sharing|social|comments?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|widget|login|signup|search|disqus|complementary|contentinfo)", re.I)
#: What a name may have beside it and still mean the same; other words beside it say more than it does inside an article.
_PLAIN_NAME = re.compile(r"(?:box|area|bar|block|container|container-fluid|content|form|group|inner|item|items|links?|lists?|outer|panel|row|section|slot|thread|unit|wrap|wrapper|left|right|top|bottom|main-?nav|site|page|global|articles|posts|stories|news|readers?|users?|visitors?|inline|small|large|js|clearfix|hidden|visible|\d+)", re.I)
#: A name that one of these begins tells of a wrapper how it is, not what it is.
_STATE = re.compile(r"(?:has|no|with|without|is|not|show|hide)(?=[_-])", re.I)
#: Attributes by the states of the format: a value is quoted only if it begins with the quote.
_ATTRIBUTES = r"""(?>=\s*+(?:"[^"]*"|'[^']*'|[^\s"'<>][^\s<>]*+)?|[^=<>]++)*+"""
_PIECE = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + rf")\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?=[\s/>]){_ATTRIBUTES})>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def gone(tag: str, rest: str, inside: bool) -> bool:
    if tag in GONE:
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    return any(gone_name(next(filter(None, m.groups()), ""), inside) for m in _NAMES.finditer(rest))


def gone_name(value: str, inside: bool) -> bool:
    """Whether a class, id or role names what goes. Outside an article one word of it is enough, unless the main
    text is named beside it; inside, all its words must be such names or plain additions, so that "share price" stays."""
    words = [w for name in value.split() if not _STATE.match(name) for w in re.split(r"[_-]+", name)]
    named = [bool(_GONE_NAME.fullmatch(w)) for w in words]
    if not any(named):
        return False
    if inside:
        return all(n or _PLAIN_NAME.fullmatch(w) for n, w in zip(named, words))
    return MAIN_NAMES.isdisjoint(value.lower().split())


def unclosed(pieces: list) -> set[int]:
    """Numbers of the pieces that open an element and have no end tag of their own; the innermost one has the next."""
    open_: dict[str, list[int]] = {}
    for k, m in enumerate(pieces):
        if tag := m.group("tag"):
            own = open_.setdefault(tag.lower(), [])
            if not m.group("end"):
                own.append(k)
            elif own:
                own.pop()
    return {k for own in open_.values() for k in own}


def blocks(html: str | None) -> list[tuple[bool, str]]:
    """(inside article or main, text) of the page's blocks that structure alone doesn't remove."""
    found: list[tuple[bool, str]] = []
    parts: list[str] = []
    inside, skip, depth = 0, "", 0  # open article or main elements; the element being skipped and its nesting

    def close() -> None:
        if parts:
            text = " ".join("".join(map(unescape, parts)).split())  # a reference doesn't run across tags
            if text:
                found.append((inside > 0, text))
            parts.clear()

    at = 0
    html = html or ""
    pieces = list(_PIECE.finditer(html))
    left_open = unclosed(pieces)
    mains = [k for k, m in enumerate(pieces) if (m.group("tag") or "").lower() in MAIN and not m.group("end")]
    torn = any(k in left_open for k in mains)  # the page ends within its main text
    for k, m in enumerate(pieces):
        if not skip and m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group("raw") and not skip and m.group("raw").lower() == "title":
                close()
            continue
        tag, end, rest = tag.lower(), bool(m.group("end")), m.group("rest")
        if skip:
            if tag == skip and tag not in VOID and not rest.endswith("/"):
                depth += -1 if end else 1
                if depth == 0:
                    skip = ""
                continue
            if tag not in MAIN or inside or end or gone(tag, rest, inside > 0):
                continue
            skip, depth = "", 0  # an article ends what was left open before it
        endless = k in left_open and (not mains or (inside > 0 and not torn))  # nobody knows how far it reaches, so it takes nothing away
        if not end and tag not in VOID and not endless and gone(tag, rest, inside > 0):
            if tag not in INLINE:
                close()
            skip, depth = tag, 1
            continue
        if tag in ("br", "img", "wbr"):
            parts.append("" if tag == "wbr" else " ")
        elif tag not in INLINE:
            close()
            if tag in MAIN:
                inside = max(0, inside - 1) if end else inside + 1
    if not skip and at < len(html):
        parts.append(html[at:])
    close()
    return found


def suffix_ranks(stream: np.ndarray, span: int) -> np.ndarray:
    """Rank of each suffix by its first span tokens; suffixes that share them share a rank."""
    rank, width = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while width < span:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-width] = rank[width:] if width < len(rank) else ahead[:-width]
        rank = np.unique((rank + 1) * (len(rank) + 2) + ahead + 1, return_inverse=True)[1]
        width *= 2
    return rank


class Stream:
    """The tokens of pages one after the other, a separator of its own after each; a token's hash holds its host's."""

    def __init__(self, pages: list[list[str]], hosts: list[int]):
        vocabulary: dict[tuple[int, str], int] = {}
        self.sizes = np.array([len(p) for p in pages], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.tokens = np.full(int(self.sizes.sum()) + len(pages), -1, np.int64)
        for k, (p, host, at) in enumerate(zip(pages, hosts, self.starts.tolist())):
            self.tokens[at : at + len(p)] = [vocabulary.setdefault((host, t), len(vocabulary)) for t in p]
            self.tokens[at + len(p)] = -2 - k
        self.row = np.repeat(np.arange(len(pages)), self.sizes + 1)
        self.hasher = Hasher(fold_case=False)
        words = self.hasher.words([t.encode("utf-8", "replace") for _, t in vocabulary])[0]
        salt = np.array([h for h, _ in vocabulary], np.int64).view(np.uint64)
        self.words = np.append(mix(words + mix(salt)), np.uint64(0))

    def runs(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of span tokens that stay in their page."""
        h = self.hasher.runs(self.words[np.maximum(self.tokens, -1)], span)
        at = np.flatnonzero((self.starts + self.sizes)[self.row[: len(h)]] - np.arange(len(h)) >= span)
        return at, h[at]


def run_counts(stream: Stream, owner: list[int], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of distinct pages) of the distinct runs of span tokens; owner has each row's page."""
    at, h = stream.runs(span)
    if not len(at):
        return h, np.zeros(0, np.uint32)
    rank, page = suffix_ranks(stream.tokens, span)[at], np.array(owner, np.int64)[stream.row[at]]
    first = np.unique(rank * (int(page.max()) + 1) + page, return_index=True)[1]
    _, place, counts = np.unique(rank[first], return_index=True, return_counts=True)
    return h[first[place]], counts.astype(np.uint32)


def covered(stream: Stream, wide: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each row's tokens, which of them a run covers whose hash is in wide, a sorted array."""
    at, h = stream.runs(span)
    at = at[in_sorted(h, wide)]
    cover = np.zeros(len(stream.tokens) + span + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + span, -1)
    marks = cover.cumsum() > 0
    return [marks[s : s + n] for s, n in zip(stream.starts.tolist(), stream.sizes.tolist())]


def unique_text(inside: bytes, texts: list[str], marks: np.ndarray | None) -> str:
    """The main text of a page of these blocks; marks has its covered tokens, None: none."""
    if marks is None:
        return "\n\n".join(texts)
    kept, at = [], 0
    for within, text in zip(inside, texts):
        words = text.split(" ")
        own = marks[at : at + len(words)]
        at += len(words)
        if within or not own.any():
            kept.append(text)
        elif not own.all():
            kept.append(" ".join(w for w, m in zip(words, own) if not m))
    return "\n\n".join(kept)


_PARSED = "page_id long, url string, host long, batch int, inside binary, blocks array<string>"
_SENT = "part int, batch int, a binary, b binary"


def _table(rows: list[tuple], names: str, types: tuple) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names.split(), cols, types)})


def _sent(rows: list[tuple]) -> pa.Table:
    return _table(rows, "part batch a b", (pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def _read(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


def _parse(batches):
    for b in sliced(batches, 4):
        parsed = [blocks(h) for h in b.column(4).to_pylist()]
        inside = pa.array([bytes(i for i, _ in p) for p in parsed], pa.binary())
        texts = pa.array([[t for _, t in p] for p in parsed], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], inside, texts], ["page_id", "url", "host", "batch", "inside", "blocks"])


def _tokens(texts: list[str]) -> list[str]:
    return [w for t in texts for w in t.split(" ")]


def extract(pages: DataFrame, batch_bytes: int = BATCH_BYTES, span: int = SPAN, least: int = PAGES) -> DataFrame:
    """(page_id, url, text)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n_batches, n_parts = sizes(total, partitions(pages.sparkSession), batch_bytes)
    batch = F.pmod(F.xxhash64("page_id"), F.lit(n_batches)).cast("int").alias("batch")
    by_batch = pages.select("page_id", "url", F.xxhash64(host).alias("host"), batch, "html").mapInArrow(_parse, _PARSED).groupBy("batch")

    def emit_hosts(t: pa.Table) -> pa.Table:
        """The batch's hosts, and which of them have a block outside article and main."""
        hosts = t.column("host").to_numpy()
        outside = np.array([0 in x for x in t.column("inside").to_pylist()], bool)
        own = np.unique(hosts).view(np.uint64)
        free = in_sorted(own, np.unique(hosts[outside].view(np.uint64)))
        number = t.column("batch")[0].as_py()
        return _sent([(p, number, own[at].tobytes(), free[at].tobytes()) for p, at in split_by_part(mix(own), n_parts)])

    def answer_hosts(t: pa.Table) -> pa.Table:
        """To each batch its hosts that have such a block in any batch."""
        hosts, free = _read(t.column("a"), np.uint64), _read(t.column("b"), bool)
        wide = np.unique(np.concatenate([h[f] for h, f in zip(hosts, free)]))
        part = t.column("part")[0].as_py()
        return _sent([(part, k, x.tobytes(), b"") for k, h in zip(t.column("batch").to_pylist(), hosts) if len(x := h[in_sorted(h, wide)])])

    def emit_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs of these hosts and their numbers of pages in the batch."""
        if not left.num_rows or not right.num_rows:
            return _sent([])
        wanted = set(np.concatenate(_read(right.column("a"), np.uint64)).view(np.int64).tolist())
        rows = [x for x in zip(left.column("host").to_pylist(), left.column("page_id").to_pylist(), left.column("blocks").to_pylist()) if x[0] in wanted]
        order = {x: k for k, x in enumerate(dict.fromkeys(r[1] for r in rows))}
        h, counts = run_counts(Stream([_tokens(r[2]) for r in rows], [r[0] for r in rows]), [order[r[1]] for r in rows], span)
        number = left.column("batch")[0].as_py()
        return _sent([(p, number, h[at].tobytes(), counts[at].tobytes()) for p, at in split_by_part(h, n_parts)])

    def answer_runs(t: pa.Table) -> pa.Table:
        """To each batch its runs on least pages of the host or more; a page is in one batch, so numbers add up."""
        hashes, counts = _read(t.column("a"), np.uint64), _read(t.column("b"), np.uint32)
        values, at = np.unique(np.concatenate(hashes), return_inverse=True)
        wide = values[np.bincount(at, np.concatenate(counts), len(values)) >= least]
        part = t.column("part")[0].as_py()
        return _sent([(part, k, x.tobytes(), b"") for k, h in zip(t.column("batch").to_pylist(), hashes) if len(x := h[in_sorted(h, wide)])])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, inside = left.column("blocks").to_pylist(), left.column("inside").to_pylist()
        marks: list[np.ndarray | None] = [None] * len(texts)
        rows = [k for k, x in enumerate(inside) if 0 in x] if right.num_rows else []
        if rows:
            hosts = left.column("host").to_pylist()
            wide = np.sort(np.concatenate(_read(right.column("a"), np.uint64)))
            for k, own in zip(rows, covered(Stream([_tokens(texts[k]) for k in rows], [hosts[k] for k in rows]), wide, span)):
                marks[k] = own
        out = [unique_text(*x) for x in zip(inside, texts, marks)]
        return pa.table({"page_id": left.column("page_id"), "url": left.column("url"), "text": pa.array(out, pa.string())})

    hosts = by_batch.applyInArrow(emit_hosts, _SENT).groupBy("part").applyInArrow(answer_hosts, _SENT)
    runs = by_batch.cogroup(hosts.groupBy("batch")).applyInArrow(emit_runs, _SENT)
    wide = runs.groupBy("part").applyInArrow(answer_runs, _SENT)
    return by_batch.cogroup(wide.groupBy("batch")).applyInArrow(finish, "page_id long, url string, text string")


def page_report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
