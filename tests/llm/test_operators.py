import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import SF_DIR, differences
from tracequarry.llm import blob_ledger, block_anchors, components, decontam, host_suffix, langid, line_quality, line_templates, ngram_join, packed, piece_viterbi, queries, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, start=0):
    """A documents table with two extra columns whose names clash with results."""
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)], COLUMNS)


def odd_documents(spark):
    """Nulls in every column, empty, blank, very long and tied texts, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, None, ""), (3, " \n\t ", "en", None, 3, 0.1, "k"), (4, long, "en", "s", len(long), 0.1, "k"), (5, long, "en", "s", len(long), 0.1, "k")]
    rows += [(6, "one", "de", "s", 3, 0.1, "k")] * 2 + [(7, "é" * 3000, "fr", "s", 3000, 0.1, "k"), (8, "a\0b \U0001f600 ́", "es", "s", 8, 0.1, "k"), (None, "no id here", "en", "s", 10, 0.1, "k")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    mine, theirs, n, m = differences(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert not mine and not theirs and n == m


def with_ids(df):
    return df.where("doc_id is not null")


REPORTS = {
    "lines": lambda d: line_templates.dedup_report(d), "quality": lambda d: line_quality.quality_report(d), "secrets": lambda d: blob_ledger.secret_report(d), "repeats": lambda d: block_anchors.removal_report(d),
    "join": lambda d: ngram_join.link_report(d), "tokens": lambda d: piece_viterbi.token_report(d), "language": lambda d: langid.language_report(d),
    "toxicity": lambda d: toxicity.toxicity_report(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(0).alias("quality"))),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_odd_rows(spark, name):
    d = odd_documents(spark)
    rows = REPORTS[name](d).collect()
    assert len(rows) >= 9
    by = {r["doc_id"]: r for r in rows}
    assert {1, 2, 3, 4, 5, 6, 7, 8} <= by.keys()
    if name == "repeats":
        assert (by[4]["n_removed"], by[5]["n_removed"], by[1]["n_words"]) == (0, 60_000, 0)
    if name == "join":
        assert by[5]["component_id"] == 4 and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2 and by[3]["component_id"] == 3
    if name == "quality":
        assert by[1]["base_failed"] and not by[1]["kept"] and by[6]["n_words"] == 1
    if name == "secrets":
        assert by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[1]["spans"] == ""
    if name == "tokens":
        assert by[1]["n_tokens"] == 0 and all(r["round_trip"] for r in rows)
    if name == "language":
        assert by[1]["lang_pred"] == "und" and by[3]["lang_pred"] == "und"


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_empty_table(spark, name):
    assert REPORTS[name](documents(spark, [])).count() == 0


def test_pages_and_benchmark_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://h/a", "", "x"), (3, "nonsense", "<p>a<p>b", "x"), (3, "nonsense", "<p>a<p>b", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in host_suffix.page_report(pages).collect()) == [(1, ""), (2, ""), (3, "a\n\nb"), (3, "a\n\nb")]
    assert host_suffix.page_report(pages.limit(0)).count() == 0
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "who was the first of them all. it was the old fox")], "item_id long, text string")
    d = documents(spark, ["x y z", None, "", "so who was the first of them all. it was the old fox ran"])
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(d, items).collect()] == [(3, 4)]
    assert decontam.contaminated(d, items.limit(0)).count() == 0 and decontam.drop_contaminated(d, items).columns == d.columns
    assert decontam.drop_contaminated(d, items).count() == 3


def sample_texts(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 160))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            other = rng.choice(base)
            w = w[: rng.randint(0, len(w))] + other + w
        out.append(" ".join(w).upper() if rng.random() < 0.1 else rng.choice([" ", "\n", " \t"]).join(w))
    return out


def naive_join(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = collections.defaultdict(set)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
                if sets[i] != sets[j]:
                    links[i].add(frozenset(sets[j]))
                    links[j].add(frozenset(sets[i]))
    return {i: (len(s), root(i), len(links[i])) for i, s in enumerate(sets)}


@pytest.mark.parametrize("group,block", [(1000, 500), (4, 3)])
@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_join_like_brute_force(spark, monkeypatch, group, block, k, num):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = sample_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(documents(spark, texts), k, num, 100).collect()}
    assert got == naive_join(texts, k, num, 100)


def test_link_paths_agree():
    rng = random.Random(5)
    import numpy as np

    members = []
    for i in range(60):
        own = np.unique(np.array([rng.randrange(80) for _ in range(60)], np.uint64))
        members.append((i, len(own), rng.randint(1, 3), own[: len(own) // 2 + 3], own))
    every = [*range(60)]
    large = set(ngram_join.find_links(members, every, every, 1, 2))
    small = {p for a in range(0, 60, 15) for b in range(a, 60, 15) for left in [every[a : a + 15]] for p in ngram_join.find_links(members, left, left if a == b else every[b : b + 15], 1, 2)}
    assert large == small and large


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {}

    def root(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    found, _ = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == {i: root(i) for i in {x for a, b in edges if a != b for x in (a, b)}}


@pytest.mark.parametrize("block", [25, 3])
def test_repeats_like_brute_force(spark, block):
    texts = sample_texts(7, 60) + ["a " * 300, "a " * 120, "b"]
    first = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 2 * block + 1):
            first.setdefault(tuple(w[k : k + 2 * block]), i)
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = set()
        for k in range(len(w) - 2 * block + 1):
            if first[tuple(w[k : k + 2 * block])] < i:
                gone |= set(range(k, k + 2 * block))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in block_anchors.removal(documents(spark, texts), block).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_hasher_tells_runs_apart():
    h = packed.Hasher(fold_case=True)
    w, counts = h.words([b"Ab  c\nd", b"", b"ab c d ab"])
    assert counts.tolist() == [3, 0, 4] and (w[:3] == w[3:6]).all() and w[6] == w[0]
    assert len(set(h.runs(w, 2).tolist())) == 3


def test_tokens_like_library(spark):
    sp = pytest.importorskip("sentencepiece")
    lib = sp.SentencePieceProcessor(model_file=piece_viterbi.DEFAULT_MODEL)
    rng = random.Random(2)
    odd = ["  a  b\tc\nｱ ﬁ  ", "日本語 テスト 😀 x", " " * 40 + "z", "a" * 300, "\t\t  if (x):\n        return  y", "http://x.yz/?q=1&r=%20"]
    texts = odd + ["".join(rng.choice("abcdefgh éß.,\n  THE ing") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    got = {r.doc_id: r for r in piece_viterbi.encode(documents(spark, texts)).collect()}
    assert all(got[i].ids == lib.encode(t) and got[i].round_trip for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in piece_viterbi.decode(piece_viterbi.encode(documents(spark, texts))).collect()}
    assert back == dict(enumerate(texts))


def test_unigram_viterbi_like_brute_force():
    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.2), ("▁a", -2.1), ("ba", -2.2), ("aba", -5.0), ("▁ab", -4.4))]
    codec = piece_viterbi.Codec(piece_viterbi.UNIGRAM, True, pieces)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(text):
        top = [0.0] + [None] * len(text)
        for j in range(1, len(text) + 1):
            top[j] = max(top[i] + score.get(text[i:j], -1e9 if j - i > 1 else codec.low) for i in range(j))
        return top[-1]

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 12)))
        marked = (" " + text).replace(" ", "▁")
        ids = codec.encode(text)
        assert abs(sum(pieces[i][1] if i else codec.low for i in ids) - best(marked)) < 1e-9


def test_decontamination_like_brute_force(spark):
    d, b = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = [(r.item_id, b" ".join(decontam.terms(r.text))) for r in b.collect()]
    texts = [(r.doc_id, b" ".join(decontam.terms(r.text))) for r in d.collect()]
    want = {(i, k) for i, t in texts for k, x in items if b" " + x + b" " in b" " + t + b" "}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert want and want <= got
    left = {r.doc_id for r in decontam.drop_contaminated(d, b).collect()}
    assert left == {i for i, _ in texts} - {i for i, _ in got}


def test_wand_is_exact():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(50)])
    for _ in range(100):
        q = rng.sample(range(len(index.vocabulary)), 25)
        scores = collections.Counter()
        for t in q:
            for i, v in index.postings[t]:
                scores[i] += v
        for theta in (0.1, 0.3, 0.6):
            assert {i for i, _ in index.wand(q, theta)} == {i for i, v in scores.items() if v >= theta - 1e-9}


def test_items_by_id_and_text(spark):
    texts = ["who was the first of them all. it was the old fox", "where does the long river end. in a salt lake far east", "what do they burn in winter. dry peat and birch logs", "why is the tower closed. the stairs have no rail left"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[0])], "item_id long, text string")
    docs = documents(spark, [f"so {t} ran" for t in texts] + ["none of it"])
    want = [(0, 1), (0, 2), (1, 1), (2, None), (3, None)]
    for how in ({}, {"most": 60}):
        assert sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, **how).collect()), key=repr) == want
        assert [r.doc_id for r in decontam.drop_contaminated(docs, items, **how).collect()] == [4]


def test_shards_change_no_score(spark):
    d, b = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    size = b.agg(F.sum(F.length("text"))).first()[0]
    whole, dealt = (sorted(map(tuple, decontam.contaminated(d, b, 0.3, most).collect())) for most in (size, size // 3))
    assert whole == dealt and whole


def test_html_blocks():
    b = host_suffix.blocks
    assert b('<div class="ad">x</div><article><p>k<br>l <i>m</i>&amp;&#33;<form>f</form></p><div class=comments><p>c</p></div></article><footer>f') == [(True, "k l m&!")]
    assert b("<nav>open<article>in</article>") == [(True, "in")] and b("<article><nav>m<p>in</article>") == [(True, "m"), (True, "in")] and b("<article><p>in<nav>torn") == [(True, "in")]
    assert b('<div id="wrapper" class="has-sidebar"><p>Hello</p></div>') == b('<div class="no-sidebar"><p>Hello</p></div>') == [(False, "Hello")]
    assert b("<!--><p>first</p><!-- x --><p>second</p><!---><p>third</p><!-- y --!>z") == [(False, "first"), (False, "second"), (False, "third"), (False, "z")]
    assert b("<nav><a>m</a><p>text") == [(False, "m"), (False, "text")] and b("<nav><nav>m</nav></nav><p>text") == [(False, "text")]
    for kind in ("reader-comments", "user-comments", "related-articles", "comments"):
        assert b(f'<article><p>k</p><div class="{kind}"><p>c</p></div></article>') == [(True, "k")]
    assert b('<article><header>h</header><p>k</p><p class="share price">s</p></article>') == [(True, "k"), (True, "s")]
    assert b("<script>'<p>x'</script>y") == [(False, "y")]


def test_host_boilerplate(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(k, f"http://h.x/{k}", f"<div>{base}</div><div>u{k} v{k} tail</div>") for k in range(200)]
    rows += [(1000 + k, "http://h.x/", f"<article><p>{base}</p></article>") for k in range(5)]
    got = {r.page_id: r.text for r in host_suffix.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"u{k} v{k} tail" for k in range(200)} | {1000 + k: base for k in range(5)}


def test_host_runs_like_brute_force(spark):
    """Templates on few and on many pages of small and large hosts; where pages are dealt changes nothing."""
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for host, n in (("large", 900), ("middle", 70), ("small", 6), ("inside", 80)):
        sections = [(say(24), share) for share in (2, 3, 5, 30, n)]
        for k in range(n):
            own = [f"<p>{t}</p>" for t, share in sections if k % max(1, n // share) == 0 and k // max(1, n // share) < share]
            tag = "article" if host == "inside" or k % 9 == 4 else "div"
            rows.append((len(rows), f"http://{host}/{k}", f"<{tag}>{''.join(own)}<p>{say(20)}</p></{tag}><p>{say(3)}</p>" if host != "inside" else f"<article>{''.join(own)}</article>"))
    rows += [(7, "http://large/", rows[7][2]), (None, "http://small/", rows[971][2]), (None, None, "<p>x")]
    parsed = [(i, (u or "").split("/")[2:3], host_suffix.blocks(h)) for i, u, h in rows]
    held = collections.defaultdict(set)
    for i, host, p in parsed:
        w = [t for _, b in p for t in b.split()]
        for k in range(len(w) - 15):
            held[(*host, *w[k : k + 16])].add(i)
    want = []
    for i, host, p in parsed:
        w = [(t, b) for b, (_, x) in enumerate(p) for t in x.split()]
        gone = {k + j for k in range(len(w) - 15) if len(held[(*host, *(t for t, _ in w[k : k + 16]))]) >= 3 for j in range(16)}
        left = [" ".join(t for k, (t, o) in enumerate(w) if o == b and (inside or k not in gone)) for b, (inside, _) in enumerate(p)]
        want.append((i, "\n\n".join(filter(None, left))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for how in ({}, {"batch_bytes": 20_000}):
        got = [(r.page_id, r.text) for r in host_suffix.extract(pages, **how).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ledger_scans_unseen_only(spark):
    v1 = spark.createDataFrame([("a", "token = abcdefghijkl"), ("b", "nothing"), ("c", "token = abcdefghijkl")], "path string, content string")
    found, ledger = blob_ledger.scan(v1)
    assert {r.path: len(r.found) for r in found.collect()} == {"a": 1, "b": 0, "c": 1}
    ledger = ledger.cache()
    v2 = spark.createDataFrame([("a", "token = abcdefghijkl"), ("d", "AKIA" + "B" * 16)], "path string, content string")
    new = blob_ledger.scan_unseen(blob_ledger.address(v2, "content"), "content", ledger=ledger)
    assert {r.kind for r in new.where("size(spans) > 0").collect()} == {"access"} and new.select("blob").distinct().count() == 1
    again, _ = blob_ledger.scan(v2, ledger=ledger)
    assert {r.path: [x.kind for x in r.found] for r in again.collect()} == {"a": ["assign"], "d": ["access"]}
    newer = (blob_ledger.Rule("assign", blob_ledger.RULES[0].pattern, version=2, group=2, least=12, base=True),)
    assert blob_ledger.scan_unseen(blob_ledger.address(v1, "content"), "content", newer, ledger).count() == 2


def test_templates_generalise(spark):
    texts = [f"intro {i} words only here {i * 7}\njob failed with code alpha{chr(97 + i)} at host node{i} port {i}\nunique line {'abc'[i % 3] * (i + 3)} tail" for i in range(20)]
    rows = {r.doc_id: r.text for r in line_templates.drop_recurring(documents(spark, texts)).collect()}
    assert "job failed" in rows[0] and not any("job failed" in rows[i] for i in range(1, 20))


def test_short_lines_recur(spark):
    import corpus_pipeline

    texts = [f"own{chr(97 + i)} line here stays\nAnd ornd.\n{i}\nPage {i}\nLes.\n\nrare{chr(97 + i // 3)}" for i in range(15)]
    docs = documents(spark, texts)
    left = {r.doc_id: r.text for r in corpus_pipeline.recurring_lines(spark, docs, SF_DIR).collect()}
    assert left == {0: texts[0]} | {i: t.replace("And ornd.\n", "").replace("Les.\n", "") for i, t in enumerate(texts) if i}
    assert {(r.doc_id == 0, r.n_lines, r.n_dropped) for r in line_templates.dedup_report(docs).collect()} == {(True, 7, 0), (False, 7, 2)}


def test_frequent_lines_go(spark):
    """More documents of a host than the limit share a line, in other case, digits and spaces; a third have little else."""
    shared = " ".join(f"notice{chr(97 + i)}" for i in range(24)) + " 12"
    rows = []
    for host, n in (("large", 51), ("even", 50), ("small", 12), (None, 12)):
        for i in range(n):
            line = shared.upper().replace("12", "  34") if i % 2 else shared
            own = " ".join(f"{host}{chr(0x4E00 + i)}word{chr(0x4E00 + k)}" for k in range(5 if i % 3 == 0 else 40))
            rows.append((len(rows), f"{own}\n{line}", "en", host, 0, 0.0, ""))
    docs = spark.createDataFrame(rows, COLUMNS)
    for limit, hosts in (((50, 0), {"large"}), ((11, 0), {"large", "even", "small", None}), ((12, 99), {"large", "even"}), ((12, 100), set()), ((), {"large", "even", "small", None})):
        got = {r.doc_id: (r.n_words, r.n_line_words_removed, r.base_failed, r.kept) for r in line_quality.quality_report(docs, *limit).collect()}
        want = {}
        for k, text, _, host, *_ in rows:
            n, lost = len(text.split()), 25 if host in hosts else 0
            want[k] = (n, lost, False, not lost or n == 65)
        assert got == want


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.language_report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    t = toxicity.toxicity_report(d, labels).join(labels, "doc_id").where("held_out")
    wrong = t.where("toxic = 0 and predicted = 1").count()
    caught = t.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert wrong <= 2 and caught > 0.5


def test_language_rejection(spark):
    model = langid.train(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    docs = documents(spark, ["the dog", "die katze", "xqz 7", "the und", None, "..."])
    scored = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert {scored[i][0] for i in range(4)} == {"en", "de"} and scored[4] == scored[5] == ("und", 0.0)
    limit = sorted(s for _, s in scored.values())[3]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, limit).collect()}
    assert got == {i: (x if s >= limit else "und", s) for i, (x, s) in scored.items()} and [x for x, _ in got.values()].count("und") == 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF_DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= rows.count()
        if name == "n-gram Jaccard join":
            before = rows.orderBy("doc_id").collect()
            naive = naive_join([r.text for r in before], 5, 80, 100)
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for i, r in enumerate(before) if naive[i][1] == i)
        rows = out
    tokens = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
    assert tokens.count() == rows.count() and tokens.where("not round_trip").isEmpty()


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, stage):
    import corpus_pipeline

    _, f = corpus_pipeline.STAGES[stage]
    clash = ["drops", "_lines", "n_lines", "n_dropped", "n_dropped_", "batch", "part", "leaf", "component", "size", "toxic", "predicted", "lines"]
    d = odd_documents(spark).select("*", *(F.lit(k).alias(c) for k, c in enumerate(clash)))
    out = f(spark, d, SF_DIR)
    if stage < 4:
        assert out.dtypes == d.dtypes
    rows = out.collect()
    kept = {r.doc_id for r in rows}
    assert {2, 3, 4, 6, 7, 8} <= kept and (stage == 2 or 5 in kept) and len(rows) >= 7
    if stage < 4:
        assert all([r[c] for c in clash] == [*range(len(clash))] for r in rows)
        want = {(r.doc_id, r.text) for r in d.collect()}
        assert {(r.doc_id, r.text) for r in rows} <= want and (None, "no id here") in {(r.doc_id, r.text) for r in rows}
    assert f(spark, d.limit(0), SF_DIR).count() == 0
