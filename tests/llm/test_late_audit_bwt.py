"""The day-file overwrite, the source audit and the merged transforms against plain versions of their contracts."""

import collections
import datetime
import glob
import hashlib
import math
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.test_operators import documents, odd_documents
from tracequarry.llm import bwt_merge, late_overwrite, source_audit

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, layout_day string, key string"
ZERO = datetime.datetime(1970, 1, 1)


def micros(t):
    return None if t is None else (t - ZERO) // datetime.timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - ZERO) // datetime.timedelta(days=1)


def text(v):
    return "" if v is None else str(v)


def sales_rows(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        sold = datetime.datetime(2024, 1, 20) + datetime.timedelta(microseconds=rng.randrange(62 * 86_400_000_000))
        arrived = sold + datetime.timedelta(seconds=rng.choice([0, 5, 4000, 900_000]))
        rows.append((rng.randrange(n * 3), rng.randrange(9), "done", rng.choice([None, 12.345, -3.5, 7.0]), rng.choice([None, sold, sold, sold]), rng.choice([None, *[arrived] * 60]), 1, "x", "y"))
    return rows + [(None, None, None, None, None, None, None, None, None), (None, 1, "held", 1.0, rows[0][4], datetime.datetime(2024, 4, 1), 2, "", "")] + rows[:20]


def plain_layout(rows):
    """Days of the rows that arrived last, by the defined ties."""
    order = lambda v: tuple((x is not None, x) if x is not None else (False,) for x in v)
    best = {}
    for r in rows:
        if r[0] not in best or order((r[5], r[4], *r)) > order((best[r[0]][5], best[r[0]][4], *best[r[0]])):
            best[r[0]] = r
    days = collections.defaultdict(list)
    for r in best.values():
        days[day(r[4])].append(r)
    return best, {d: sorted(v, key=lambda r: ((r[4] is not None, r[4] or ZERO), (r[0] is not None, r[0] or 0))) for d, v in days.items()}


def plain_files(rows, rows_a_file):
    everything = list(rows)
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if r[0] is not None and r[4] is not None and h % 3 == 0 and day(r[4]) % 4 == 0:
            later = r[5] and r[5] + datetime.timedelta(days=1 + h % 97)
            everything.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + datetime.timedelta(days=h % 2), later, *r[6:]))
    early = [r for r in everything if r[5] is not None and r[5] < datetime.datetime(2024, 3, 20)]
    late = [r for r in everything if not (r[5] is not None and r[5] < datetime.datetime(2024, 3, 20))]
    start, _ = plain_layout(early)
    best, days = plain_layout(everything)
    dirty = set()
    for k, r in best.items():
        if r in late and not (r in early):
            dirty |= {day(r[4])} | ({day(start[k][4])} if k in start else set())
    out = {}
    for d, v in days.items():
        for i in range(0, len(v), rows_a_file):
            f = v[i : i + rows_a_file]
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in f)
            crc = sum(zlib.crc32(f"{text(r[0])}:{text(micros(r[4]))}:{text(micros(r[5]))}".encode()) for r in f)
            out[d, i // rows_a_file] = (len(f), cents, crc, hashlib.sha256(",".join(text(r[0]) for r in f).encode()).hexdigest(), d in dirty)
    return out


def test_day_files_like_plain_version(spark, monkeypatch):
    monkeypatch.setattr(late_overwrite, "ROWS_A_FILE", 90)
    rows = sales_rows(600)
    report = late_overwrite.overwrite_report(spark.createDataFrame(rows, SALES).repartition(5)).collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in report} == plain_files(rows, 1 + len(rows) // 90)
    assert len({r.rewritten for r in report}) == 2
    paths = {urllib.parse.urlparse(r.path).path for r in report}
    root = os.path.dirname(os.path.dirname(os.path.dirname(min(paths))))
    assert set(glob.glob(f"{root}/**/*.parquet", recursive=True)) == paths
    names = [c.split()[0] for c in SALES.split(", ")]
    for r in report:
        held = pq.ParquetFile(urllib.parse.urlparse(r.path).path).read()
        assert held.column_names == names and r.columns == ",".join(names)
        assert hashlib.sha256(",".join(map(text, held["sale_id"].to_pylist())).encode()).hexdigest() == r.ids_sha256


def test_untouched_days_stay(spark):
    rows = [(k, 1, "done", 1.0, t := datetime.datetime(2024, 3, 2 + k % 5, 1, k), t, 1, "", "") for k in range(40)]  # eight a day
    layout = late_overwrite.Layout(spark.createDataFrame(rows, SALES), late_overwrite.new_folder(spark, "days"), 3)
    assert layout.day == "layout_day_"
    layout.write(late_overwrite.last(late_overwrite.keyed(spark.createDataFrame(rows, SALES))))
    index = layout.write_index(late_overwrite.new_folder(spark, "index"))
    plan = spark.table(index).join(spark.table(index).select("key"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the index is read in its buckets
    files = lambda: {p: open(p, "rb").read() for p in glob.glob(f"{urllib.parse.urlparse(layout.root).path}/**/*.parquet", recursive=True)}
    before = files()
    moved = (0, 1, "held", 2.0, datetime.datetime(2024, 3, 4), datetime.datetime(2024, 4, 1), 1, "", "")  # from the 2nd to the 4th
    assert layout.overwrite(late_overwrite.keyed(spark.createDataFrame([moved], SALES)), index) == [19784, 19786]
    after = files()
    stay = {p for p in before if not re.search("=1978[46]/", p)}
    assert stay and all(before[p] == after[p] for p in stay) and len(after) == len(before)
    assert sorted(r["sale_id"] for r in layout.read().collect()) == list(range(40))


def test_empty_sales(spark):
    assert late_overwrite.overwrite_report(spark.createDataFrame([], SALES)).collect() == []


def plain_audit(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, lang, source in rows]
    df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, terms in docs:
        df.update({(lang, t) for t in terms})
        counts[lang, source].update(terms)
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for (l, t), n in df.items() if l == lang and n >= least]
        def p_of(count):
            n, v = sum(count[t] for t in kept), len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (n + 2 * v) for t in kept}
        p, q = p_of(own), p_of(sum((c for (l, _), c in counts.items() if l == lang), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        ranked = sorted(((-f(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]))[:top]
        out |= {(lang, source, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(ranked)}
        others = [(s, p_of(c)) for (l, s), c in counts.items() if l == lang and s != source]
        ranked = sorted((-sum(f(p[t], o[t]) for t in kept), s.encode()) for s, o in others)
        out |= {(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(ranked)}
    return out


def audit_rows(seed=3):
    rng = random.Random(seed)
    words = [*"alpha Beta gamma ÄRGER éa 한국 x delta eps".split(), *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", "-1_", "\0Q"]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "hot", "hot", "hot"])) for _ in range(150)]
    return rows + [(None, "en", "void"), ("", "xx", "s1"), ("one two", "xx", "s2"), ("zz " * 30_000, "en", "a"), (None, None, None)] + rows[:9]


def test_audit_like_plain_version(spark):
    rows = audit_rows()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, part string, rank int").repartition(4)
    found = source_audit.divergences(d).collect()
    assert {tuple(r) for r in found} == plain_audit(rows) and len(found) == len(plain_audit(rows))
    assert source_audit.divergences(d.limit(0)).collect() == []


def test_sketch_never_underestimates(spark, monkeypatch):
    """A narrow sketch lets more through and loses nothing."""
    monkeypatch.setattr(source_audit, "NARROWEST", 64)
    monkeypatch.setattr(source_audit, "WIDEST", 64)
    rows = audit_rows(8)
    d = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in source_audit.divergences(d).collect()} == plain_audit(rows)


def test_sketch_drops_rare_terms(spark):
    rows = [(" ".join(f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + j)}" for j in range(20)) + " common", "en", "s") for k in range(300)]
    texts = spark.createDataFrame(rows, "text string, lang string, source string").select("lang", "source", "text")
    bits = source_audit.sketch_bits(texts, 1 << 16, 10)
    assert 1 <= np.unpackbits(bits).sum() <= 4 + 8
    assert [r["term"] for r in source_audit.term_counts(texts).collect()] == ["common"]


def plain_repeats(rows, span=50):
    seen, out = {}, {}
    for doc_id, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            seen.setdefault(b[p : p + span], doc_id)
    for doc_id, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1) if doc_id is not None else ():
            if seen[b[p : p + span]] < doc_id:
                gone[p : p + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(doc_id, []).append((len(b), [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))], kept))
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    words = [*"one two three éü 四五 six".split(), "x" * 70, "\0", "\n"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(40)]
    passage = " ".join(str(rng.random()) for _ in range(12))
    texts += [t[rng.randrange(9) :] for t in texts[:9]] + [f"{rng.random()} {passage} {rng.random()}" for _ in range(12)]
    return texts + ["a" * 400, "a" * 49, "a" * 50, "ab" * 200, "b" + "ab" * 60, "", None, passage * 3, passage * 40]


@pytest.mark.parametrize("shard", [1_000_000, 300])
def test_byte_repeats_like_plain_version(spark, monkeypatch, shard):
    monkeypatch.setattr(bwt_merge, "SHARD_BYTES", shard)
    texts = repeated_texts(shard)
    ids = [*range(len(texts) - 3), 5, 5, None]
    rows = list(zip(ids, texts))
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, batch int").repartition(3)
    got = collections.defaultdict(list)
    for r in bwt_merge.repeats(d).collect():
        got[r.doc_id].append((r.n_bytes, [(s["start"], s["length"]) for s in r.spans], bytes(r.kept)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain_repeats(rows).items()}


def test_byte_repeats_on_odd_tables(spark):
    by = {r["doc_id"]: r for r in bwt_merge.repeat_report(odd_documents(spark)).collect()}
    assert by[5]["n_removed"] == by[4]["n_bytes"] > 0 == by[4]["n_removed"] and by[5]["n_spans"] == 1
    assert by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by[7]["n_bytes"] == 6000 and by[None]["n_removed"] == 0
    assert bwt_merge.repeat_report(documents(spark, [])).collect() == []


def test_suffix_array_like_sorting():
    rng = random.Random(2)
    for _ in range(50):
        data = bytes(rng.choices(b"ab\0\xff", k=rng.randrange(1, 300))) + b"\xff"
        assert bwt_merge.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda k: data[k:])


@pytest.mark.parametrize("span", [7, 8, 50])
def test_merged_blocks_are_the_intervals(span):
    """The refined interleave of several shards' transforms is the order of all windows, and its blocks their equal prefixes."""
    rng = random.Random(span)
    shards, windows = [], []
    for s in range(4):
        text = bytes(rng.choices(b"ab", [5, 1], k=900))
        at = np.unique(np.array([rng.randrange(900 - span - 31) for _ in range(20)]))
        count = np.minimum(np.array([rng.randrange(1, 31) for _ in at]), np.append(np.diff(at), 31))
        raw = np.frombuffer(text, np.uint8)
        (part, before, ended, own), = bwt_merge.transform(raw, at, count, np.zeros(len(at), np.int64), span)
        shards.append((before, ended, count[own].astype(np.uint8), np.full(len(own), s)))
        windows += [[text[at[f] + j : at[f] + j + span] for j in range(count[f])] for f in own]
    fragment, window, late = bwt_merge.merged(shards, span)
    order = [windows[f][j] for f, j in zip(fragment, window)]
    assert len(order) == sum(map(len, windows)) and order == sorted(order)
    shard_of = np.repeat(np.arange(4), [len(s[2]) for s in shards])
    least = {}
    for f, j in zip(fragment, window):
        least[windows[f][j]] = min(least.get(windows[f][j], 9), shard_of[f])
    assert late.tolist() == [shard_of[f] > least[windows[f][j]] for f, j in zip(fragment, window)]


def test_four_byte_passes_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 250, 30_000).astype(np.uint8)  # too many pairs of bytes for passes of four
    at, count = np.arange(0, 20_000, 25), np.full(800, 25)
    (_, before, ended, own), = bwt_merge.transform(raw, at, count, np.zeros(800, np.int64), 50)
    fragment, window, late = bwt_merge.merged([(before, ended, count.astype(np.uint8), np.arange(800))], 50)
    keys = [raw[at[own[f]] + j :][:50].tobytes() for f, j in zip(fragment, window)]
    assert keys == sorted(keys) and not late.any()
