"""The operators' methods against plain versions of them."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import documents, naive_join
from tests.oracle import SF_DIR
from tracequarry.llm import blob_ledger, common, decontam, host_suffix, langid, line_quality, ngram_join, packed, piece_viterbi, toxicity

# --- toxicity ---


def plain_features(text, learned):
    tokens = (text or "").split()
    n, chars = max(len(tokens), 1), max(len(text or ""), 1)
    hits, second, mixed_words, stretched, kinds, weights = [], [], 0, 0, set(), []
    seeds = learned_hits = 0
    for i, t in enumerate(tokens):
        low = t.strip(toxicity._EDGES).lower()
        mixed = any(c.isalpha() for c in low) and any(c in "@$!*0123456789._" for c in low)
        word = low.translate(toxicity._PLAIN) if mixed else low
        keys = [k for k in [f"={word}", *(word[:x] for x in (4, 5, 6, 7) if len(word) >= x)] if learned.get(k, 0) > 0]
        best = max(keys, key=lambda k: (learned[k], k.startswith("="), -len(k)), default=None)
        seed = word in toxicity.SEEDS
        seeds += seed
        if best:
            learned_hits += 1
            kinds.add(best)
            weights.append(learned[best])
        if seed or best:
            hits.append(i)
        if low in toxicity.SECOND:
            second.append(i)
        mixed_words += mixed
        stretched += any(a == b == c for a, b, c in zip(low, low[1:], low[2:]))
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
    capitals, marks, shouts = (sum(f(c) for c in text or "") for f in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ".__contains__, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".__contains__, "!?".__contains__))
    return [math.log1p(len(tokens)), seeds / n, learned_hits / n, len(kinds), sum(weights) / math.sqrt(n), max(weights, default=0), near / n, len(second) / n, capitals / chars, marks / chars, shouts / chars, mixed_words / n, stretched / n]


def test_features_like_plain_version():
    rng = random.Random(8)
    learned = {"=zork": 2.5, "blar": 2.1, "=hate": 3.0, "snee": 4.0, "sneez": 2.0}
    words = ["you", "You,", "zork", "z0rk", "ZORK!", "blarney", "sneezing", "idiot", "1d10t", "st*pid", "h.a.t.e", "sooo", "plain", "déjà", "u", "42", "a_b", "...", "dumm"]
    lexicon = toxicity.Lexicon(learned)
    for text in [None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(200))]:
        assert toxicity.features(text, lexicon) == pytest.approx(plain_features(text, learned))


def test_boosting_like_plain_version():
    """Each tree's splits are the best of all cuts of all features, by plain loops."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = ((x[:, 0] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    prior, trees = toxicity.boost(x, y)
    least, f = max(3, min(toxicity.LEAST_ROWS, len(y) // 100)), np.full(len(y), prior)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])) for j in range(3)]
    for feats, own_cuts, leaves in trees[:6]:
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
        node = [list(range(len(y)))]
        for level in range(toxicity.LEVELS):
            below = []
            for k, rows in enumerate(node):
                rows, at = np.array(rows, int), (1 << level) - 1 + k
                gains = [-math.inf]
                for j in range(3):
                    for c in cuts[j]:
                        left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                        if len(left) >= least and len(right) >= least:
                            gains.append(score(left) + score(right) - score(rows))
                high = x[rows, feats[at]] > own_cuts[at]
                if math.isfinite(own_cuts[at]):
                    assert score(rows[~high]) + score(rows[high]) - score(rows) == pytest.approx(max(gains))
                else:
                    assert max(gains) <= 1e-6
                below += [rows[~high].tolist(), rows[high].tolist()]
            node = below
        for rows, value in zip(node, leaves):
            assert value == pytest.approx(toxicity.RATE * g[rows].sum() / (h[rows].sum() + 1) if rows else 0.0)
            f[rows] += value
    assert toxicity.raw_scores(x, prior, trees[:6]) == pytest.approx(f)


def test_isotonic_like_plain_version():
    """Knots are the pooled means that a quadratic minimax formula gives, but for their pseudo-count."""
    rng = np.random.default_rng(3)
    f = rng.permutation(60).astype(float)
    y = (rng.random(60) < f / 60).astype(float)
    xs, ys = toxicity.isotonic(f, y)
    t = y[np.argsort(f)]
    fit = [max(min(t[a : b + 1].mean() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    pools = [(len(list(g)), v) for v, g in itertools.groupby(np.round(fit, 9))]
    want = [(v * n + 0.5 * y.mean()) / (n + 0.5) for n, v in pools for _ in range(n)]
    assert np.interp(np.arange(60.0), xs, ys) == pytest.approx(np.maximum.accumulate(want))


def test_odd_labels_and_columns(spark):
    texts = [f"you idiot zork{i % 5} blar" if i % 4 == 0 else f"a calm text number {i}" for i in range(400)]
    labels = [(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(1, 2), (2, -1), (3, None), (None, 1), (4, 1), (4, 1), (5, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, texts).withColumn("_score", F.lit("mine"))
    left = toxicity.keep_clean(docs, labels)
    assert left.columns == docs.columns and {r._score for r in left.collect()} == {"mine"}
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == 400 and all((r.score >= 0.7) == r.predicted and 0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted for i in range(0, 400, 4)) > 80 and not any(got[i].predicted for i in range(400) if i % 4)


# --- decontamination ---


def test_decontamination_both_ways(spark):
    """Every passage against every item: plain BM25 shares, then the overlaps; no match more or less."""
    rng = random.Random(12)
    words = [f"t{i}" for i in range(70)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(4, 14))) + ". " + " ".join(say(rng.randint(2, 6))) + ".") for i in range(40)]
    texts = []
    for _ in range(60):
        w = say(rng.randint(0, 80))
        if rng.random() < 0.6:
            own = decontam.terms(rng.choice(items)[1])
            own = [t.decode() for t in own]
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randint(0, len(w))
            w[at:at] = own
        texts.append(" ".join(w))
    bags = [decontam.terms(t) for _, t in items]
    mean, df = sum(map(len, bags)) / len(bags), collections.Counter(t for b in bags for t in set(b))
    step = max(map(len, bags))

    def weight(t, bag):
        tf = bag.count(t)
        idf = math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (decontam.K1 + 1) / (tf + decontam.K1 * (1 - decontam.B + decontam.B * len(bag) / mean))

    def longest(a, b):
        return max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if any(b[k : k + n] == a[i : i + n] for k in range(len(b) - n + 1))), default=0)

    want = {}
    for d, text in enumerate(texts):
        w = decontam.terms(text)
        for at in range(0, len(w), step):
            passage = w[at : at + 2 * step]
            for (item, t), bag in zip(items, bags):
                score = sum(weight(x, bag) for x in set(bag) & set(passage)) / sum(weight(x, bag) for x in set(bag))
                if score < decontam.THRESHOLD - 1e-9:
                    continue
                question, answer = decontam.question_and_answer(t)
                n = min(decontam.SHINGLE, len(question))
                own = {tuple(question[i : i + n]) for i in range(len(question) - n + 1)}
                have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                asked, answered = (len(own & have) / len(own) if n else 1.0), longest(answer, passage) / len(answer)
                if asked >= decontam.QUESTION and answered >= decontam.ANSWER:
                    want[d, item] = max(want.get((d, item), (0.0, 0.0, 0.0)), (round(score, 6), asked, answered))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("score", F.lit(1))
    got = {(r.doc_id, r.item_id): (round(r.score, 6), r.question_overlap, r.answer_overlap) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    assert got == want and len(want) > 20


def test_long_and_repeated_items(spark):
    long = " ".join(f"w{i % 613}" for i in range(9000)) + ". the very end of it all."
    bench = spark.createDataFrame([(1, long), (1, long), (2, "")], "item_id long, text string")
    docs = documents(spark, ["before " + long + " after", long[: len(long) // 3], " ".join(["pad"] * 30_000) + " " + long])
    for most in (10**7, 1000):
        assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, most=most).collect()) == [(0, 1), (2, 1)]


# --- Jaccard join ---


def chain(n, own=30):
    """Texts that each share three words in a row with the next one, and nothing else."""
    link = lambda i: " ".join(f"l{i}x{k}" for k in range(3))
    return [f"{link(i)} {' '.join(f'o{i}x{k}' for k in range(own))} {link(i + 1)}" for i in range(n)]


def test_chains_fall_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    texts = chain(40) + [f"{t} {t}" if i % 9 == 0 else t for i, t in enumerate(chain(12, 60)) for _ in range(2)]
    rows = ngram_join.document_sets(documents(spark, texts), 3, 60, 100, True).where("prefix is not null").drop("ids", "key")
    sets = rows.dropDuplicates(["doc_id"])
    near, paths = ngram_join.placed(sets, 60, 100)
    assert all(r.component == r.doc_id or r.size <= 6 for r in near.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(documents(spark, texts), 3, 60, 100).collect()}
    assert got == naive_join(texts, 3, 60, 100)


def test_hot_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 10)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(200)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.join(documents(spark, texts), 3, 80, 100).collect()}
    assert got == naive_join(texts, 3, 80, 100)


def test_bitmap_bound_loses_nothing():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(1, 4000) for _ in range(rng.choice([5, 60, 900, 1500]))], np.uint64)) for _ in range(60)]
    for k in range(0, 60, 3):  # near copies
        sets[k + 1] = np.unique(np.concatenate([sets[k][: int(len(sets[k]) * 0.97) + 1], [np.uint64(9000 + k)]]))
    rows = [(i, len(s), len(s), ngram_join.bitmap(s, len(s))) for i, s in enumerate(sets)]
    for num in (50, 80, 90):
        ok = ngram_join.within_bound(rows, rows, num, 100)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                inter = len(np.intersect1d(a, b))
                assert ok[i, j] or 100 * inter < num * (len(a) + len(b) - inter)
    assert ok.sum() < 60 * 60 / 4


def test_exchange_rows_grow_with_the_input():
    rows = [math.prod(packed.sizes(gb * 10**9, 200)) / gb for gb in (30, 300, 3000)]
    assert max(rows) < 1.1 * min(rows)
    assert packed.sizes(0, 8) == (24, 8)


# --- quality rules ---


def test_lines_count_distinct_documents(spark):
    line = " ".join(f"notice{chr(97 + i)}" for i in range(24))
    rows = [(i // 3, f"{line}\nown{i // 3}", "h") for i in range(30)] + [(100 + i, f"{line}\nown{i}", "g") for i in range(12)] + [(None, line, "n")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.n_line_words_removed) for r in line_quality.quality_report(docs, 10, 0).collect()}
    assert {x for i, x in got if i is not None and i < 100} == {0} and {x for i, x in got if i is not None and i >= 100} == {24} and (None, 0) in got


# --- HTML ---


def test_html_attribute_states():
    b = host_suffix.blocks
    assert b("<p title=it's>hello</p>") == [(False, "hello")] and b('<a href="x"y">z</a>') == [(False, "z")]
    assert b("<p a = 'x>y' b=\"<i>\">q</p>") == [(False, "q")] and b("<article>&<b>amp;</b> &amp;lt;</article>") == [(True, "&amp; &lt;")]
    assert b('<article><div class="share price">keep</div><div class="share-links">no</div><div id=comments>no</div></article>') == [(True, "keep")]
    assert b('<div class="comments-off main">keep</div><div class="site-footer dark">no</div>') == [(False, "keep")]
    assert b("3 < 4 <br>5<wbr>6 <x") == [(False, "3 < 4 56 <x")]


def test_very_long_and_tied_pages(spark):
    words = " ".join(f"w{i % 4001}" for i in range(150_000))
    rows = [(k, "http://a/", f"<p>{words}</p>", k, "clash") for k in range(2)] + [(9, "http://a/", "<p a=" * 30_000, 9, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, batch int, text string")
    got = {r.page_id: r.text for r in host_suffix.page_report(pages).collect()}
    assert got[0] == got[1] == words
    third = spark.createDataFrame([(2, "http://a/", f"<p>{words}</p>", 2, "clash")], pages.schema)
    assert {r.page_id: r.text for r in host_suffix.page_report(pages.unionByName(third)).collect() if r.page_id < 3} == {0: "", 1: "", 2: ""}


# --- secrets ---


def test_rounds_change_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    addressed = blob_ledger.address(docs, "content")
    plain = blob_ledger.scan_unseen(addressed, "content")
    for rounds in (2, 3):
        folded = blob_ledger.ledger_in_rounds(addressed, "content", rounds=rounds)
        assert sorted(map(repr, folded.collect())) == sorted(map(repr, plain.collect()))  # no pair is scanned twice


# --- language ---


def test_only_letters_are_letters():
    assert not any(map(langid.has_letter, ["", "²½", "Ⅷ 42", "_-", "٣", "😀"])) and all(map(langid.has_letter, ["²a", "é", "日", "ª", "3 x"]))


def test_language_table_is_the_mean_embedding():
    texts, langs = ["the cat and the dog", "der hund und die katze", "le chat et le chien"] * 8, ["en", "de", "fr"] * 8
    labels, sparse = sorted(set(langs)), [langid.bag(t) for t in texts]
    target = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(langid.SEED)
    order = rng.permutation(len(texts))
    embed, out, bias = langid.descend(sparse, target, 3, order[len(order) // 5 :], rng)
    model = langid.train(texts, langs)
    for t in [*texts, "ein anderer text", "x", "Á"]:
        data = (" " + t.lower() + " ").encode()
        rows = []
        for k, n in enumerate(langid.ORDERS):
            for i in range(len(data) - n + 1):
                v = int.from_bytes(data[i : i + n], "big")
                v = v if n == 2 else (v * (2654435761 if n == 3 else 2246822519) % 2**32) >> 16
                rows.append(embed[k * langid.BUCKETS + v])
        z = (np.mean(rows, 0, dtype=np.float64) @ out + bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = model.predict(t)
        assert lang == model.labels[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(i, f"texte {i}", "fr") for i in range(3000, 3040)] + [(5, "same", "en")] * 500 + [(9000, "x" * 200_000, "en"), (9001, "y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(r.lang for r in langid.training_rows(d, F.lit(True), 300).collect())
    assert 200 < got["en"] < 400 and got["fr"] == 40 and set(got) == {"en", "fr"}
    repeated = d.limit(0).unionByName(spark.createDataFrame([(1, "same", "en")] * 2000 + [(i, f"text {i}", "en") for i in range(2, 42)], d.schema))
    assert langid.training_rows(repeated, F.lit(True), 100).count() == 41  # 41 documents, whatever their rows
    some = langid.training_rows(spark.createDataFrame([(i, "x" * 1000, "en") for i in range(1000)], d.schema), F.lit(True), 1000, 100_000)
    assert 50 < some.count() < 200


def test_training_like_plain_descent():
    """The averaged table's scores against embeddings averaged and classified one row at a time."""
    texts, langs = ["abc abd", "xyz xyw", "abd abc abe", "xyw xyz", "abe", "xyv"] * 5, ["a", "x"] * 15
    model = langid.train(texts, langs)
    labels = sorted(set(langs))
    assert model.labels == labels
    order = np.random.default_rng(langid.SEED).permutation(len(texts))
    used = order[len(order) // 5 :]
    embed, out, bias = langid.descend([langid.bag(t) for t in texts], np.array([labels.index(x) for x in langs]), 2, used, _after(langid.SEED, len(texts)))
    for t in texts[:6]:
        ids, w = langid.bag(t)
        raw = (w @ embed[ids]) @ out + bias
        p = np.exp((raw - raw.max()) / model.temperature)
        lang, score = model.predict(t)
        assert lang == labels[int(p.argmax())] == t[0] and abs(score - p.max() / p.sum()) < 1e-4


def _after(seed, n):
    rng = np.random.default_rng(seed)
    rng.permutation(n)
    return rng


def test_many_items_in_little_memory(monkeypatch):
    """Groups of passages change no result."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, f"{' '.join(rng.choices(words, k=12))}? {' '.join(rng.choices(words, k=3))}") for k in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) + " " + items[k][1] for k in range(40)]
    whole = decontam.Index(items).matches(texts)
    monkeypatch.setattr(decontam, "WORK", 500)
    assert decontam.Index(items).matches(texts) == whole and sum(map(len, whole)) >= 40


# --- SentencePiece ---


def test_bpe_scores_like_brute_force():
    """Of all segmentations into pieces, the stable ones are one; the pass finds it, and the library has it too."""
    sp = pytest.importorskip("sentencepiece")
    with open(piece_viterbi.DEFAULT_MODEL, "rb") as f:
        codec = piece_viterbi.Codec(*piece_viterbi.read_model(f.read()))
    lib = sp.SentencePieceProcessor(model_file=piece_viterbi.DEFAULT_MODEL)

    def ways(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in codec.ids:
                for rest in ways(text[k:]):
                    yield (codec.ids[text[:k]], *rest)

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("aehinrst") for _ in range(rng.randint(1, 9)))
        stable = [w for w in ways("▁" + text) if all(codec.merge(codec.text[a] + codec.text[b]) == [a, b] for a, b in zip(w, w[1:]))]
        best = max(stable, key=lambda w: sum(codec.score[i] for i in w))
        assert len(stable) == 1 and codec.segment("▁" + text) == list(best) == lib.encode(text)


# --- shared pieces ---


def test_slices_are_bounded():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 90, 30, 500, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    got = [b.column(1).to_pylist() for b in common.sliced([batch], 1, most=100, rows=2)]
    assert sum(got, []) == texts and [len(g) for g in got] == [2, 1, 1, 2, 1]
    assert [*common.sliced([batch.slice(0, 0)], 1)] == []


def test_written_tables_go(spark):
    before = common.written()
    kept, path = common.saved(spark.range(5).toDF("a"))
    _, other = common.saved(spark.range(5).toDF("a"))
    common.release(spark, before, keep=(path,))
    assert kept.count() == 5 and common.written() == before + 1
    with pytest.raises(Exception):
        spark.read.parquet(other).count()
    common.release(spark, before)
