"""The numbered operators: brute force, round trips, held-out accuracy, and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import check
from trustlake.llm import _blocks, ann, decontamination, html_extraction, katz_lm, language_id, minhash_dedup, mixing, quality, queries, substring_dedup, warc
from trustlake.llm._session import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, packed int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
WORD = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    texts = [(1, f"start {PASSAGE} end"), (11, f"a {PASSAGE}"), (11, " ".join(f"own{k}" for k in range(16))), (2, f"other {PASSAGE}"), (3, f"start {PASSAGE} end"), (4, None), (5, ""), (6, "short text"), (7, "word " * 30000), (8, "short text"), (2, f"other {PASSAGE}"), (None, f"x {PASSAGE}"), (9, " \t\n "), (10, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 2}", 1, "h", 1) for k, (i, t) in enumerate(texts)], DOCS).repartition(3)


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(WORD, t or "")
            for p in range(len(w) - 12):
                key = tuple(w[p : p + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = re.findall(WORD, t or "")
        gone = set()
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in substring_dedup.substring_dedup(odd).collect()]
    assert sorted(got, key=str) == brute_substrings(rows)
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0
    check(substring_dedup.op1_substring_dedup(spark, SF), substring_dedup.ORACLE, SF)


def test_mixing(spark, odd):
    check(mixing.op2_mixing(spark, SF), mixing.ORACLE, SF)
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("p", (0.001, 0.5, 0.999))
def test_mixing_bins_are_even_and_in_order(spark, p):
    odds = p / (1 - p)
    rows = spark.range(20_000).withColumn("u", (F.col("id") + 0.5) / 20_000).withColumn("rank", F.col("u") / (1 - F.col("u")) / odds)
    bins = rows.select("rank", mixing._bin(F.col("rank"), F.lit(odds)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).orderBy("bin").collect()
    assert max(b.n for b in bins) <= 7 and all(x.b < y.a for x, y in zip(bins, bins[1:], strict=False))


def test_buckets_of_stepped_ids_are_even():
    ids = np.arange(0, 4_000_000, 100)
    counts = np.bincount(_blocks.doc_bucket(ids, 400), minlength=400)
    assert len(counts) == 400 and counts.min() > 50 and counts.max() < 200 and set(_blocks.doc_bucket(-ids, 400)) <= set(range(400))


def test_html(spark):
    page = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><article><h2>Ti&amp;tle</h2><p>First <b>bold</b>\n words<br>here<p>Second.</article><div class='comments'><p>me too</p></div><footer>(c)</footer></body></html>"
    assert html_extraction.main_text(page) == "Ti&tle\nFirst bold words here\nSecond."
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (3, "v", "", 3), (4, "w", "<p>cut off <b", 4), (4, "w", "plain", 4)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(df).collect()}
    assert {(2, "", 0), (3, "", 0), (4, "cut off", 7), (4, "plain", 5)} <= got
    assert html_extraction.extract(df.limit(0)).count() == 0


class Article(HTMLParser):
    """Blocks of all text inside articles, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.pieces, self.depth = [], [], 0

    def cut(self):
        text = " ".join("".join(self.pieces).split())
        self.blocks += [text] if text else []
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in html_extraction.BLOCK:
            self.cut()
        elif tag == "br":
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        if tag in html_extraction.BLOCK:
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.pieces.append(data)


def test_html_against_another_parser(spark):
    """The given pages keep their prose in an article that holds nothing else."""
    for r in html_extraction.op3_html_extraction(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        p = Article()
        p.feed(r.html)
        p.close()
        p.cut()
        assert r.text == "\n".join(p.blocks) and r.n_chars == len(r.text)


def test_html_density_decides():
    """The same page with and without an article element, and odd rows."""
    prose = "It was the best of times and it was the worst of times, and we had all of it before us in the city where he was."
    menu = "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(8))
    for tag in ("article", "div", "section"):
        page = f"<div><ul>{menu}</ul></div><{tag}><h2>Title</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p></{tag}><div>Contact Imprint Jobs Press</div><div><a href='/a'>Terms</a> <a href='/b'>Privacy</a></div>"
        assert html_extraction.main_text(page).split("\n")[:4] == ["Title", prose, "Short one.", prose]
        assert "Section" not in html_extraction.main_text(page) and "Terms" not in html_extraction.main_text(page)
    # An article doesn't make links prose.
    assert html_extraction.main_text(f"<article><p>{prose}</p><p><a href='/x'>{prose}</a></p></article>") == prose
    assert html_extraction.main_text(f"<form action='/'><article><p>{prose}</p></article></form>") == prose
    assert html_extraction.main_text("<p>Let <math><mi>x</mi></math> be the <object>number</object> of it.</p>") == "Let x be the number of it."
    assert html_extraction.main_text("<p>" + "word the of and " * 50_000) == ("word the of and " * 50_000).strip()


def test_html_drops_nothing_by_look_alikes():
    said = "It was the best of times and it was the worst of times, and we had all of it before us in the city."
    assert html_extraction.main_text(f"<p>{said} See <a href='/articles/hidden-costs'>the costs</a> of it.</p>") == f"{said} See the costs of it."
    for attrs in ('title="the hidden life"', 'data-id="related"', 'class="overflow-hidden"', 'class="content-widget"', 'class="social-post"'):
        assert html_extraction.main_text(f"<div {attrs}><p>{said}</p></div>") == said
        assert html_extraction.main_text(f"<section {attrs}><article><h1>Short</h1><p>{said}</p></article></section>") == f"Short\n{said}"
    assert html_extraction.main_text(f"<p>{said}</p><div hidden><p>{said}</p></div><div class='sidebar'>{said}</div><div class='related-posts'>More</div>") == said


def test_html_names_inside_an_article():
    """Names and asides of an article are features: its prose stays, its link lists and what no prose is go."""
    said = "It was the best of times and it was the worst of times, and we had all of it before us in the city."
    for part in (f'<h2 id="search">Search</h2><p>{said}</p>', f'<h2 id="comments">On comments</h2><p>{said}</p>', f'<h2 class="social">Social</h2><p>{said}</p>', f'<p id="notice">{said}</p>', f'<p class="alert">{said}</p>', f'<section id="discussion"><h2>Discussion</h2><p>{said}</p><p>So far.</p></section>', f'<section class="related"><h3>Related work</h3><p>{said}</p></section>', f"<aside><p>{said}</p></aside>", f"<menu><li>{said}</li></menu>"):
        want = [x for x in re.split(r"<[^>]*>", part) if x]
        page = f"<nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{said}</p>{part}<p>{said}</p><p>Short.</p></article><footer>End</footer>"
        assert html_extraction.main_text(page) == "\n".join(["Title", said, *want, said, "Short."])
    for part in ('<section class="related"><h3>Related</h3><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></section>', "<aside>Buy now</aside>", '<div class="ad">Buy it now</div>', f'<div class="comments"><p>{said}</p></div>', f'<div class="notice">{said}</div>', f"<nav>{said}</nav>", '<p>' + "<a href='/t'>Ruby</a> Python Java Scala Kotlin <a href='/u'>Haskell Erlang Smalltalk Fortran Cobol</a> Prolog Lisp Scheme Ada Pascal</p>", '<div class="share-buttons">Share this</div>'):
        page = f"<article><h1>Title</h1><p>{said}</p><p>First.</p><p>Second.</p>{part}<p>{said}</p></article>"
        assert html_extraction.main_text(page) == f"Title\n{said}\nFirst.\nSecond.\n{said}"


def test_html_by_blocks_alone(spark):
    """The given pages without any telling tag or name: link lists are rejected by their links, nearly all prose stays."""
    kept = n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        bare = re.sub(r"<(/?)(article|nav)\b", r"<\1div", r.html)
        assert bare != r.html
        text = html_extraction.main_text(r.html).split("\n")
        left = html_extraction.main_text(bare).split("\n")
        menu = [x for x in re.findall(r"<li><a [^>]*>([^<]*)</a></li>", r.html) if x not in text]
        assert not set(menu) & set(left)
        kept += len(set(text) & set(left))
        n += len(set(text))
    assert kept >= 0.98 * n


def classes_by_force(rows):
    bags = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [(t or "").split()]}
    n = len(rows)
    df = collections.Counter(s for i, t in rows for s in set(bags[i]))
    idf = {s: minhash_dedup.Idf.of(n, c) for s, c in df.items()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = {}
    items = sorted(dict(rows).items())
    for k, (a, ta) in enumerate(items):
        for b, tb in items[:k]:
            near = bool((ta or "").split()) and ta == tb
            if not near and bags[a] and bags[b]:
                keys = bags[a].keys() | bags[b].keys()
                low, high = (sum(idf[s] * f(bags[a][s], bags[b][s]) for s in keys) for f in (min, max))
                near = low / high >= 0.8 - 1e-9
            if near:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    del texts
    return {i: find(i) for i, _ in rows}


def test_minhash(spark, odd):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(4)]
    rows = []
    for i in range(60):
        w = base[i % 4].split()
        for _ in range(i % 3):
            w[rng.integers(len(w))] = f"n{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_force(rows)
    out = [tuple(r) for r in minhash_dedup.minhash_dedup(odd).collect()]
    assert len(out) == odd.count() and (3, 1, 1) in out and (8, 6, 6) in out and (4, 4, 4) in out and (None, None, None) in out
    assert minhash_dedup.minhash_dedup(odd.limit(0)).count() == 0


def test_minhash_large_groups(spark):
    """Hundreds of different texts in one bucket, about as alike as the threshold: all links of pairs with a common band count."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        w = [f"w{k}" for k in range(120)]
        for at in rng.choice(24, rng.integers(1, 5), replace=False):
            w[5 * at + 2] = f"e{at}v{rng.integers(3)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == classes_by_force(rows)


def test_minhash_frequencies(spark):
    """Shingles of many texts are counted exactly, wherever their texts lie; the rest needs no count."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        w = [f"v{x}" for x in rng.integers(0, 10**6, int(rng.integers(5, 300)))]
        for k in range(6):
            if i % (3 + 20 * k) == 0:
                w += f"common phrase number {k} of many texts".split()
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "common phrase number 0 of " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = minhash_dedup.frequencies(docs)
    df = collections.Counter(h for _, t in rows if t for h in set(minhash_dedup.shingles(minhash_dedup.pa.array([t]))[1].tolist()))
    want = {h: n for h, n in df.items() if n >= len(rows) / minhash_dedup.THETA}
    assert len(want) > 8 and dict(zip(got.heavy.tolist(), got.value[:-1].tolist(), strict=True)) == {h: minhash_dedup.Idf.of(len(rows), n) for h, n in want.items()}


def tokens(t):
    return re.findall(WORD, (t or "").translate({i: i + 32 for i in range(65, 91)})) + ["\0"]


def katz_by_force(rows, learn, head, slots):
    """(doc_id, tokens, known, score, base_score) of each row in plain Python, after checking that all contexts sum to one."""

    def digest(w):
        return 1 if w == "\0" else int(katz_lm._tokens(katz_lm.pa.array([w]))[0][0])

    one, two, texts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if learn(i):
            one.update(tokens(t))
            texts += 1
    n = sum(one.values())
    least = max(1, -(-n // head))
    of = lambda w: w if one[w] >= least or w == "\1" else digest(w) % slots
    for i, t in rows:
        if learn(i):
            k = tokens(t)
            two.update((of(v), of(w)) for v, w in zip(["\1", *k[:-1]], k, strict=True))
    by = collections.Counter(one.values())
    d1 = katz_lm.discounts([0, *(by[r] for r in range(1, 7))])
    freed = sum((1 - d1[r]) * r * by[r] for r in range(1, 6))
    total = n if freed > 0 else n + 1
    unknown = (freed if freed > 0 else 1) / total / (slots + 1)
    p1 = lambda w: d1[min(one[w], 6)] * one[w] / total if one[w] else unknown
    mass, size = collections.Counter({s: unknown for s in [("no text has it",), *range(slots)]}), collections.Counter({"\1": texts})
    for w, c in one.items():
        mass[of(w)] += p1(w)
        size[of(w)] += c
    by = collections.Counter(two.values())
    d2 = katz_lm.discounts([0, *(by[r] for r in range(1, 7))])
    star, low = collections.Counter(), collections.Counter()
    for (v, c), x in two.items():
        star[v] += d2[min(x, 6)] * x
        low[v] += mass[c]

    def p(v, c):
        x, t = two[v, c], size[v] + 1
        return d2[min(x, 6)] * x / t if x else mass[c] * (1 - star[v] / t) / (1 - low[v])

    for v in ["\1", *size]:
        assert math.isclose(sum(p(v, c) for c in mass), 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        k = tokens(t)
        score = sum(math.log10(p(of(v), of(w)) * p1(w) / mass[of(w)]) for v, w in zip(["\1", *k[:-1]], k, strict=True))
        out.append((i, len(k), sum(one[w] > 0 for w in k), float(score), sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in k)))
    return n, sorted(out, key=str)


@pytest.mark.parametrize(("head", "slots"), [(1 << 20, 8), (16, 4), (1, 2)])
def test_katz(spark, odd, head, slots):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rng = np.random.default_rng(5)
    rows += [(100 + k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 50)) for k in range(60)]
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    scores, m, tables = katz_lm.katz(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held, head=head, slots=slots)
    n, want = katz_by_force(rows, lambda i: i is None or i % 3, head, slots)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.score, r.base_score) for r in scores.collect()), key=str)
    assert m.tokens == n and [g[:3] for g in sorted(got, key=str)] == [w[:3] for w in want]
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(math.isclose(g[k], w[k], rel_tol=1e-10) for k in (3, 4))]
    assert not wrong, wrong[:3]
    assert tables["unigrams"].agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("head", [1 << 20, 40, 8, 1])
def test_katz_in_a_corpus_beyond_the_head(spark, odd, head, monkeypatch):
    """However many tokens the head holds, each is a context and a follower of its own: the scores are those of a corpus that fits."""
    monkeypatch.setattr(katz_lm, "SLOTS", 8)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rng = np.random.default_rng(6)
    rows += [(100 + k, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 80))) % 90)) for k in range(70)]
    # No training text has the words of 300 and 303; one has those of 306.
    rows += [(i, "new words only here, new words only here t1 once t1") for i in (300, 303)] + [(i, "words of two texts t1 words of two t2") for i in (305, 306)]
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    scores, m, tables = katz_lm.katz(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held, head=head)
    n, want = katz_by_force(rows, lambda i: i is None or i % 3, 1 << 60, 8)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.score, r.base_score) for r in scores.collect()), key=str)
    assert m.tokens == n and any(w[2] < w[1] for w in want) and [g[:3] for g in got] == [w[:3] for w in want]
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(math.isclose(g[k], w[k], rel_tol=1e-10) for k in (3, 4))]
    assert not wrong, wrong[:3]
    assert len(m.hash) <= head and {r.kind for r in tables["answers"].select("kind").distinct().collect()} >= ({"new"} if head > n else {"rare_context", "rare_new"})


def test_katz_without_texts(spark, odd):
    scores, m, _ = katz_lm.katz(odd, F.lit(True))
    assert m.tokens == 0 and scores.count() == odd.count() and scores.agg(F.sum("n_known")).first()[0] == 0
    assert katz_lm.katz(odd.limit(0), F.lit(False))[0].count() == 0


def test_katz_beats_base(spark):
    held = katz_lm.op5_katz_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [1.0, 2.0]), (None, [1.0] * 16), (5080, [])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, width=96).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    x = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        hit += len(set(best) & set(got[q]))
        total += 20
        assert len(got[q]) == 20
    assert hit / total >= 0.95 and got.get(5060, []) == [] and not {5000, 5020, 5040, 5080} & set(got)


def test_ann_odd_rows(spark):
    """Doubles that floats can't hold, clashing columns, repeated ids, few candidates, an empty table."""
    rows = [(0, [1.0, 2.0], 1, 1), (20, [1e300, -1.0], 1, 1), (1, [1.0 + 1e-12, 2.0], 1, 1), (1, [1.0 + 1e-12, 2.0], 1, 1), (1, [0.5, 0.5], 1, 1), (2, [1.0], 1, 1), (3, [float("inf"), 1.0], 1, 1), (4, [None, 1.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int, shard int")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 20, 1e300 - 2.0), (0, 2, 1, 1.0 + 1e-12 + 4.0), (0, 3, 1, 1.5)]
    assert [r[2] for r in got[3:]] == [1, 0, 1] and ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality(spark, odd):
    rows = quality.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    right, n = rows.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right / n > 0.9
    none = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.score(odd, none, quality.held_out(F.col("doc_id"))).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)


def tiles_by_force(item, doc, least):
    """Longest unmarked common runs one after the other, by trying all positions."""
    free_a, free_b, found = [True] * len(item), [True] * len(doc), []
    while True:
        best, at = 0, []
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_a[i + n] and free_b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best:
                    best, at = n, []
                if n == best:
                    at.append((i, j))
        if best < least:
            return found
        for i, j in at:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                found.append((i, j, best))


def test_tiles_by_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        kinds = rng.integers(2, 8)
        a, b, least = rng.integers(0, kinds, rng.integers(1, 16)), rng.integers(0, kinds, rng.integers(0, 30)), int(rng.integers(1, 5))
        assert decontamination.tiles(a, b, least) == tiles_by_force(a.tolist(), b.tolist(), least)
    assert decontamination.tiles(np.full(5000, 7), np.full(25000, 7), 5) == [(0, 0, 5000)]


def plain_tokens(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def decontaminated_by_force(docs, items):
    out = []
    for item_id, text in items:
        item = plain_tokens(text)
        least = min(5, len(item))
        seeds = {tuple(item[k : k + least]) for k in range(len(item) - least + 1)} if item else set()
        for doc_id, body in docs:
            doc = plain_tokens(body)
            hit = sorted({k + x for k in range(len(doc) - least + 1) if tuple(doc[k : k + least]) in seeds for x in range(least)}) if seeds else []
            if None in (item_id, doc_id) or not hit:
                continue
            near = [x for k, p in enumerate(hit) for x in ([object()] if k and p > hit[k - 1] + 1 else []) + [doc[p]]]
            found = tiles_by_force(item, near, least)
            covered = sum(n for _, _, n in found)
            if covered >= 0.5 * len(item):
                out.append((doc_id, item_id, len(item), covered, len(found)))
    return sorted(out)


def test_decontamination(spark, odd):
    words = [f"b{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words), 0), (2, "tiny item", 0), (3, None, 0), (4, "", 0)], "item_id long, text string, doc_id int")
    texts = [(1, "intro " + " ".join(words).upper() + " outro"), (2, " ".join(words[10:]) + " filler, words " + " ".join(words[:10])), (3, " ".join(words[:8])), (4, "a tiny item here"), (5, None), (6, "nothing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {(1, 1, 1, 1.0), (2, 1, 2, 1.0), (4, 2, 1, 1.0)}
    assert decontamination.decontaminate(odd, items.limit(0)).count() == 0 and decontamination.decontaminate(odd.limit(0), items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0), most_seeds=0).count() == 0


def test_decontamination_by_force(spark, odd):
    """Both paths on odd rows against odd items, and on the given tables."""
    items = [(1, PASSAGE), (1, PASSAGE), (2, "word " * 300), (3, "short text"), (None, PASSAGE), (4, None), (5, " ,. "), (6, "x" * 5000)]
    docs = [(r.doc_id, (r.text or "")[:3000] if r.doc_id == 7 else r.text) for r in odd.collect()]
    own, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = decontaminated_by_force(docs, items)
    assert len(want) > 10
    for most in (decontamination.MOST_SEEDS, 0):
        got = [tuple(r)[:5] for r in decontamination.decontaminate(own, bench, most_seeds=most).collect()]
        assert sorted(got) == want or most == 0 and set(got) == set(want)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = decontaminated_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    for most in (decontamination.MOST_SEEDS, 0):
        assert sorted(tuple(r)[:5] for r in decontamination.decontaminate(docs, bench, most_seeds=most).collect()) == want


def test_language(spark, odd):
    rows = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.98
    out = {r.doc_id: r.lang_pred for r in language_id.predict(odd, language_id.fit(odd)).collect()}
    assert out[4] == out[5] == out[9] == "und" and out[1] == "en"
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(odd.limit(0))).collect()} == {"und"}


def test_warc(spark):
    check(warc.op10_warc(spark, SF), warc.ORACLE, SF)
    rows = [(1, "http://a.org/x", "same", 0), (2, "http://b.org/y", "same", 0), (3, None, None, 0), (4, "http://a.org/x", "", 0), (None, "http://c.org/ü z", "un\r\n\r\nlike", 0), (2, "http://b.org/y", "same", 0), (7, "https://www.a.org/x", "secure", 0), (8, "http://a.org/x", "long " * 500_000, 0), (9, "", "no url", 0), (9, "http://d.org", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha long").repartition(3)
    folder = f"{shared_dir(spark)}/test-archive"
    warc.index(warc.write(pages, folder), folder)
    want = sorted([(1, 4, "revisit", 9), (2, 4, "revisit", 9), (2, 4, "revisit", 9), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 10, "response", None), (7, 6, "response", None), (8, 2_500_000, "response", None), (9, 6, "response", None), (9, 4, "response", None)], key=str)
    found = warc.lookup(pages, folder).collect()
    for got in (warc.read(spark, folder).collect(), found):
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want
    held = {(r.url, r.page_id): r.html for r in found}
    assert held["http://c.org/ü z", None] == "un\r\n\r\nlike" and held["http://a.org/x", 8] == "long " * 500_000 and ("http://a.org/x", 7) not in held
    one = warc.lookup(pages.filter("page_id = 7"), folder).collect()
    assert [(r.url, r.page_id, r.html) for r in one] == [("https://www.a.org/x", 7, "secure")]
    assert warc.surt("https://www.m.example.org/a?b=1") == "org,example,m)/a?b=1"
    none = f"{shared_dir(spark)}/no-archive"
    warc.index(warc.write(pages.limit(0), none), none)
    assert warc.lookup(pages, none).count() == 0 and warc.read(spark, none).count() == 0


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classes = classes_by_force([(i, r.text) for i, r in docs.items()])
    bad = {r.doc_id for r in decontamination.op8_decontamination(spark, SF).collect()}
    kept = {r.doc_id for r in rows}
    assert kept and all(classes[i] == i for i in kept) and not kept & bad
    assert all(r.copies >= 1 and r.taken == r.copies * len(r.text.split()) for r in rows)


def test_registration():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13
