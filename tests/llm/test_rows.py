"""Rows that are hard to tell apart (null, repeated and shared ids, copies), hot keys, and searches that stop early, all against
brute force."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import htmltext, langid, licenses, linededup, mixing, neighbours, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


# near-duplicates


def near_dedup(rows):
    """Rows (doc_id, text) that stay, by comparing all pairs."""
    fp = [simhash.fingerprint(t) for _, t in rows]
    group = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    best = {}
    for g, (i, t) in zip(group, rows):
        best.setdefault(g, []).append((i is None, i or 0, i, t))
    return {g: ({x[3] for x in b if x[:2] == min(b, key=lambda x: x[:2])[:2]}, min(b, key=lambda x: x[:2])[2]) for g, b in best.items()}


def test_near_dedup_by_row(spark):
    r = random.Random(1)
    long = prose(r, 300)
    rows = [(1, "alpha beta gamma delta"), (1, "wholly other words in here"), (2, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "a text without an id"), (None, "a text without an id")]
    rows += [(5, long), (5, long), (6, long.replace("mu", "nu", 1)), (7, None), (7, ""), (8, None), (9, prose(r, 200)), (9, prose(r, 200))]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, fp int").withColumn("component", F.lit("own"))
    got = simhash.dedup(docs).collect()
    want = near_dedup(rows)
    assert len(got) == len(want) and got[0].component == "own"
    left = list(want.values())
    for x in got:
        hit = next(w for w in left if x.doc_id == w[1] and x.text in w[0])
        left.remove(hit)
    assert not left and not simhash.dedup(docs.limit(0)).collect()


def test_components_of_fingerprints(spark):
    """Chains, far pairs and one hot block of bits that is cut into chunks, against all pairs."""
    r = np.random.default_rng(3)
    fps = list(r.integers(0, 1 << 63, 300, dtype=np.uint64))
    for x in fps[:60]:
        for _ in range(6):
            x = x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 6)), replace=False)))
            fps.append(x)
    low = np.uint64((1 << 33) - 1)
    fps += [(np.uint64(x) & ~low) | np.uint64(12345) for x in r.integers(0, 1 << 63, 5000, dtype=np.uint64)]
    fps = np.unique(np.array(fps, np.uint64))
    n = len(fps)
    pairs = []
    for i in range(n):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)
        pairs += [(i, i + 1 + int(j)) for j in near]
    group = classes(n, pairs)
    ids = [(i * 7919) % n for i in range(n)]
    least = defaultdict(lambda: n)
    for i, g in enumerate(group):
        least[g] = min(least[g], ids[i])
    prints = spark.createDataFrame([(ids[i], int(fps[i].astype(np.int64))) for i in range(n)], "doc_id long, fp long")
    got = {x.fp: x.component_id for x in simhash.classes_of(prints).collect()}
    assert got == {int(fps[i].astype(np.int64)): least[g] for i, g in enumerate(group)}


# repeated lines


def brute_lines(rows, min_lines=2, min_words=10):
    """Text left of each row, by looking for every run of lines among all earlier ones; rows are in corpus order."""
    blank = " \t\n\x0b\f\r"
    units = [re.split(r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", t) if t is not None else None for t in rows]
    place = [(d, i, u.strip(blank)) for d, us in enumerate(units) for i, u in enumerate(us or ()) if u.strip(blank)]
    docs = defaultdict(list)
    for k, (d, i, line) in enumerate(place):
        docs[d].append((i, line))
    gone = defaultdict(set)
    seen = Counter()
    seen_one = Counter()
    for d in sorted(docs):
        lines = docs[d]
        for k in range(len(lines)):
            run = tuple(x[1] for x in lines[k : k + min_lines])
            if len(run) == min_lines:
                if seen[run]:
                    gone[d] |= {x[0] for x in lines[k : k + min_lines]}
                seen[run] += 1
            if seen_one[lines[k][1]] and (min_lines == 1 or len(lines[k][1].split()) >= min_words):
                gone[d].add(lines[k][0])
            seen_one[lines[k][1]] += 1
    return [None if us is None else "\n".join(u for i, u in enumerate(us) if i not in gone[d]) for d, us in enumerate(units)]


@pytest.mark.parametrize("min_lines, min_words", [(2, 10), (4, 3), (1, 1), (3, 99), (5, 99), (6, 3), (7, 99)])
def test_lines_by_row(spark, min_lines, min_words):
    r = random.Random(min_lines)
    pool = [prose(r, r.choice([1, 2, 4, 12])) for _ in range(14)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(40)] + [None, "", "\n \n", "\n".join(pool * 60)]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(3, texts[7])] * 3 + [(None, texts[9])] * 3 + [(None, pool[0])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(1 << 62)).alias("o"), F.xxhash64("text").alias("f")).collect()
    order = sorted(order, key=lambda x: (x.o, x.f))
    want = Counter((x.doc_id, t) for x, t in zip(order, brute_lines([x.text for x in order], min_lines, min_words)))
    got = linededup.dedup(docs.withColumn("u", F.lit("own")), min_lines, min_words=min_words).collect()
    assert Counter((x.doc_id, x.text) for x in got) == want and got[0].u == "own"


def test_lines_of_equal_rows(spark):
    got = linededup.dedup(spark.createDataFrame([(None, "a b\nc d")] * 3, "doc_id long, text string")).collect()
    assert sorted(x.text for x in got) == ["", "", "a b\nc d"]


# nearest neighbours


def test_nearest_with_shared_ids(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (5, [0.0, 2.0]), (1, [0.0, 9.0]), (9, [0.0, 9.0])]
    table = spark.createDataFrame([(*x, "own") for x in rows], "vec_id long, embedding array<double>, h1 string")
    got = [(x.vec_id, x.score) for x in neighbours.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1.0), (5, 1.0), (1, 8.0), (9, 8.0)]


def brute_nearest(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_nearest_exact_with_ties_and_copies(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 3, (3000, 4)).astype(float) + 1.0  # 81 different vectors: exact ties and many copies everywhere
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for row in neighbours.nearest(table, F.col("vec_id") % 100 == 0, look=None).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for q in range(0, 3000, 100):
        best, d = brute_nearest(x, q)
        assert [g[0] for g in got[q]] == best.tolist() and [g[1] for g in got[q]] == d[best].tolist()


def test_recall_where_the_queue_stops_early(spark):
    """50 000 vectors without structure, at the shipped parameters."""
    r = np.random.default_rng(5)
    x = r.normal(size=(50_000, 32)).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for row in neighbours.nearest(table, F.col("vec_id") % 250 == 0).collect():
        got[row.query_id].append((row.vec_id, row.score))
    y = x.astype(float)
    hits = 0
    for q in range(0, 50_000, 250):
        best, d = brute_nearest(y, q)
        hits += len({g[0] for g in got[q]} & set(best.tolist()))
        assert all(math.isclose(s, d[v], rel_tol=1e-12) for v, s in got[q]) and len(got[q]) == 10
    print("recall", hits / 2000)
    assert hits / 2000 >= 0.9


def test_clusters_take_a_short_look(spark, monkeypatch):
    """30 000 vectors around 300 centres: a query finds nine of ten neighbours in a tenth of the index."""
    r = np.random.default_rng(6)
    x = (r.normal(size=(300, 32))[r.integers(0, 300, 30_000)] * 4 + r.normal(size=(30_000, 32))).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    looked = []
    true = neighbours.measured
    monkeypatch.setattr(neighbours, "measured", lambda *a: looked.append(true(*a)) or looked[-1])
    got = defaultdict(set)
    for row in neighbours.nearest(table, F.col("vec_id") % 300 == 0, least=100).collect():
        got[row.query_id].add(row.vec_id)
    y = x.astype(float)
    hits = sum(len(got[q] & set(brute_nearest(y, q)[0].tolist())) for q in range(0, 30_000, 300))
    print("looked at", looked, "recall", hits / 1000)
    assert looked[0] < 3000 and hits / 1000 >= 0.9


def test_copies_of_a_row_are_near_each_other(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.lit(True)).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == [(1, 1, 1, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 1, 1.0), (2, 3, 1, 1.0)]


# language models


def brute_kneser_ney(texts, order=langid.ORDER):
    """log P(c | before) as a function, from counts in dictionaries."""
    counts = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        x = [0] * (order - 1) + langid.normalize(t).tolist()
        for i in range(order - 1, len(x)):
            counts[order][tuple(x[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    tables = {}
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables[n] = (c, min(0.9, max(0.1, ones / max(1, ones + 2 * twos))), total, kinds)
    vocabulary = len(counts[1]) + 1

    def p(before, ch, n):
        if n == 0:
            return 1 / vocabulary
        ctx = tuple(before[len(before) - n + 1 :])
        c, d, total, kinds = tables[n]
        if not total[ctx]:
            return p(before, ch, n - 1)
        own = max(0.0, c[(*ctx, ch)] - d) if c[(*ctx, ch)] else 0.0
        return own / total[ctx] + d * kinds[ctx] / total[ctx] * p(before, ch, n - 1)

    return p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    texts = ["abab cab", "bca abc", "ccba ab a", "bab cac", "der die das", "cabcab abd"]
    monkeypatch.setattr(langid, "COUNTED_OF_8", 8)
    model = langid.train(spark.createDataFrame([(None, "xx", t) for t in texts], "doc_id long, lang string, text string"))
    p = brute_kneser_ney(texts)
    for t in ("abc cab", "zzz abd", "d"):
        x = langid.normalize(t)
        logs = model.log_probs(np.concatenate((np.zeros(langid.ORDER, np.uint32), x)))[langid.ORDER :, 0]
        padded = [0] * (langid.ORDER - 1) + x.tolist()
        want = [math.log(p(padded[i : i + langid.ORDER - 1], c, langid.ORDER)) for i, c in enumerate(x.tolist())]
        assert np.allclose(logs, want, rtol=1e-4, atol=1e-4)


def test_sample_is_bounded_for_null_and_repeated_ids(spark, monkeypatch):
    taken = []
    keep = langid.materialize
    monkeypatch.setattr(langid, "materialize", lambda df, name: (lambda out: (taken.append((name, out)), out)[1])(keep(df, name)))
    rows = [(None, "aa", "ein satz")] * 20_000 + [(7, "bb", "une phrase")] * 20_000 + [(i, "cc", "a word") for i in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sample=1000)
    sample = dict(taken)["langid-sample"].groupBy("lang").count().collect()
    assert model.langs == ["aa", "bb", "cc"] and all(700 < r["count"] < 1300 or r["lang"] == "cc" for r in sample)


# licenses


def test_license_texts_with_changes(spark):
    r = random.Random(2)
    rows = []
    for label, words, base in licenses.LIBRARY:
        if not base and len(words) >= 60:
            changed = [w if r.random() > 0.02 else r.choice(WORDS) for w in words]
            at = r.randrange(len(changed))
            rows.append((label, " ".join([prose(r, 50), *changed[:at], "extra", *changed[at:], prose(r, 40)])))
    unrelated = [("", prose(r, 300)), ("", "this software and the terms of its use are for you to read in the world of free words " * 9), ("", "")]
    docs = spark.createDataFrame(rows + unrelated, "label string, text string").withColumns({"k1": F.lit(0), "spans": F.lit(1)})
    for x in licenses.scan(docs).collect():
        assert x.label in x.labels.split(",") if x.label else x.labels == "", x.label


def test_license_copies_are_no_hot_key(spark):
    rows = [("released under the mit license " + WORDS[0],)] * 400 + [(f"word {i}",) for i in range(100)]
    got = Counter(x.labels for x in licenses.scan(spark.createDataFrame(rows, "text string")).collect())
    assert got == {"mit": 400, "": 100}


# mixing


def test_schedule(spark):
    r = random.Random(6)
    rows = [(None if i % 5 == 0 else i // 2, prose(r, r.randint(0, 30)), r.choice(["a", "b", None])) for i in range(300)] + [(3, "same words here", "a")] * 20
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(plan) == len(rows) and len({x.row for x in plan}) == len(rows)
    s = spark.createDataFrame(plan)
    copies = mixing.schedule(s).collect()
    want = sorted((p, x.key, x.size, x.row, k) for x in plan for k, p in enumerate((x.first_position, x.second_position)) if p is not None)
    assert [(c.row, c.copy) for c in sorted(copies, key=lambda c: c.place)] == [(w[3], w[4]) for w in want]
    assert sorted(c.place for c in copies) == list(range(len(want)))
    for source in ("a", "b", None):
        mine = [x for x in plan if x.source_size == next(y.source_size for y in plan if y.target == x.target)]
        assert mine
    taken = Counter()
    for x in plan:
        taken[x.target] += x.taken
    assert all(abs(t - n) <= 1 for t, n in taken.items())


def test_more_than_two_copies_are_refused(spark):
    rows = spark.createDataFrame([(1, "one two", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="most"):
        mixing.mix(rows, share=3.0, most=3.0)
    with pytest.raises(ValueError, match="min_lines"):
        linededup.dedup(rows, 0)


# web pages


def parsed(html):
    return htmltext.strip(*htmltext.page(html), frozenset())


def test_names_of_purpose():
    assert parsed('<div class="content no-sidebar"><p>Whole article text.</p></div>') == "Whole article text."
    assert parsed('<div class="search-results"><p>The story...</p></div>') == "The story..."
    assert parsed('<p class="share-price">Shares rose.</p>') == "Shares rose."
    assert parsed('<article><p>a</p><section class="related-work"><p>What others did.</p></section><div class="related-posts">x</div></article>') == "a\nWhat others did."
    assert parsed('<p>one two three four</p><div class="ad-slot">x</div><div id=cookieNotice>y</div><ul class="site-nav"><li>z</ul><div class="post-comments">long comment text that is far longer</div>') == "one two three four"
    assert parsed('<form id="page"><div class="sidebar"><article><h1>t</h1><p>body</p></article></div><label>x</label></form>') == "t\nbody"


def test_marks_that_hold_little():
    story = "".join(f"<p>Paragraph {i} of the story.</p>" for i in range(20))
    told = "\n".join(f"Paragraph {i} of the story." for i in range(20))
    assert parsed(f'<div class="story">{story}</div><article><p>Teaser.</p></article>') == f"{told}\nTeaser."
    assert parsed(f"<article>{story}<article><p>Nested.</p></article></article><p>Outside.</p>") == f"{told}\nNested."
    for role in ('role="main"', "role='main'", "role=main", "ROLE = Main"):
        assert parsed(f"<div {role}>{story}</div><p>Outside.</p>") == told, role
    assert parsed(f'<article>{story}<article class="comment"><p>Me too.</p></article></article>') == told
    assert parsed(f'<main>{story}<section id="comments"><article class="comment"><p>Me too.</p></article></section></main>') == told
    assert parsed(f'<article class="post">{story}</article>') == told and parsed("<article></article><p>All.</p>") == "All."


def test_quotes_in_tags():
    assert parsed("<a title=it's>Hello</a><p>I don't know > that.</p>") == "Hello\nI don't know > that."
    assert parsed('<p class="a>Lost text</p>') == "Lost text" and parsed('<p>a<img alt="x"" src="y">b</p>') == "ab"
    assert parsed('<p class="a>Lost</p><p class="b">and "said" found</p>') == 'Lost\nand "said" found'
    assert parsed("""<p title="a > b" data-x='<i>"</i>'>kept</p>""") == "kept" and parsed("<p title = 'a>b'/>c") == "c"
    assert parsed('<p title="said class=comments">kept</p><div title="x class=sidebar y">too</div>') == "kept\ntoo"
    for page in ('<p a="' * 20_000, "<p a=' =" * 20_000, "<p " + "= " * 100_000, "<p " + "a" * 300_000, "<p class" + " " * 300_000 + "x", '="' * 100_000 + "<b " + '="' * 100_000):
        began = time.time()
        htmltext.page(page)
        assert time.time() - began < 3, page[:20]


def test_labels():
    assert parsed("<p>One <label>two</label> three.</p>") == "One two three." and parsed("<div><label>Name</label><input></div><p>text</p>") == "text"
    assert parsed("<form><p>Your <label>name</label></p></form><p>text</p>") == "text" and parsed("<p><span>One <b><label>two</label></b></span></p>") == "One two"


def test_marks_against_whole_trees(spark):
    """Pages without marks, with teasers, and with articles in articles, each text on one page alone but for a menu on all."""
    r = random.Random(12)
    pages, n = [], iter(range(10**6))
    some = lambda k: "".join(f"<p>{prose(r, r.randint(1, 9))} {next(n)}</p>" for _ in range(k))
    for _ in range(80):
        inner = f"<article>{some(r.randint(0, 2))}</article>" if r.random() < 0.4 else ""
        parts = [f"<div>{some(r.randint(0, 4))}</div>", *(f"<{t}>{some(r.randint(0, 4))}{inner}</{t}>" for t in r.choices(("article", "main", "div"), k=r.randint(0, 3)))]
        r.shuffle(parts)
        pages.append(f"<body><div><ul><li>home</li><li>about this site and its many other pages</li></ul></div>{''.join(parts)}</body>")

    def walk(node, inside, held=False):
        for c in node[1]:
            if isinstance(c, str):
                if not c.startswith(("home", "about this")):
                    held.append((inside, c))
            else:
                walk(c, inside or c[0] in ("article", "main"), held)
        return held

    want = []
    for html in pages:
        t = Tree()
        t.feed(html)
        texts = walk(t.stack[0], False, [])
        held = sum(len(c) for inside, c in texts if inside)
        want.append("\n".join(c for inside, c in texts if inside or not held or 2 * held < sum(len(x) for _, x in texts)))
    rows = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumns({"inside": F.lit("own"), "texts": F.lit(1), "hashes": F.lit(2)})
    got = {x.page_id: x.text for x in htmltext.extract(rows).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_deep_pages_are_quick():
    for page in ("<div>" * 3000 + "x" + "</div>" * 3000, "<div>" * 3000 + "</b>" * 3000 + "<p>x<i>" * 3000, "<span>" * 3000 + "<div>x</div>" * 3000, "<li>x" * 9000):
        began = time.time()
        htmltext.page(page)
        assert time.time() - began < 2  # quadratic work takes far longer


class Tree(HTMLParser):
    """Well-formed pages as nested lists (tag, children)."""

    def __init__(self):
        super().__init__()
        self.stack = [("root", [])]

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, []))
        self.stack[-2][1].append(self.stack[-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.split():
            self.stack[-1][1].append(" ".join(data.split()))


def brute_extract(pages, min_pages=5, min_share=0.2):
    """Texts of well-formed pages of one host without marked articles, all subtrees compared as strings."""
    trees = []
    for html in pages:
        t = Tree()
        t.feed(html)
        trees.append(t.stack[0])

    def walk(node):
        yield node
        for c in node[1]:
            if not isinstance(c, str):
                yield from walk(c)

    def texts(node, gone):
        out = []
        for c in node[1]:
            if isinstance(c, str):
                out.append(c)
            elif not (c[0] != "body" and repr(c) in gone):
                out += texts(c, gone)
        return out

    def recurring(each):
        n = Counter(h for hs in each.values() for h in hs)
        return {h for h, c in n.items() if c >= min_pages and c >= min_share * len(each)}

    by_html = {h: {repr(n) for n in walk(t) if n[0] not in ("root", "body")} for h, t in zip(pages, trees)}
    first = recurring(by_html)
    own = defaultdict(set)
    for h, t in zip(pages, trees):
        own[tuple(sorted(set(texts(t, first))))] |= by_html[h] & first
    gone = recurring(own)
    return ["\n".join(texts(t, gone)) for t in trees]


def test_templates_against_whole_trees(spark):
    r = random.Random(8)
    part = lambda d: f"<div>{''.join(part(d - 1) for _ in range(r.randint(1, 2)))}</div>" if d else f"<p>{prose(r, 3)}</p>"
    shared = [part(r.randint(0, 3)) for _ in range(8)]
    pages = []
    for i in range(60):
        body = [r.choice(shared) if r.random() < 0.6 else part(r.randint(0, 2)) for _ in range(r.randint(2, 8))]
        pages.append(f"<body><p>page {i}</p>{''.join(body)}</body>")
    pages += [pages[0]] * 20 + ["<body></body>"]
    rows = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumns({"k1": F.lit("own"), "blocks": F.lit(1)})
    got = {x.page_id: x.text for x in htmltext.extract(rows).collect()}
    assert [got[i] for i in range(len(pages))] == brute_extract(pages)


# the pipeline


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as P

    r = random.Random(9)
    text = lambda: "\n".join(prose(r, 15) for _ in range(4))
    rows = [(i, text(), "en", r.choice(["s", "t", None])) for i in range(60)] + [(i, "der die das und ist nicht " * 8 + str(i), "de", "s") for i in range(60, 90)]
    rows += [(None, text(), None, None)] * 3 + [(5, rows[5][1], "en", "s")] * 2 + [(7, None, "en", "s"), (8, "", None, "t"), (9, "12 34", "en", None), (10, "word " * 30_000, "en", "s")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("rank", F.lit("own"))
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in P.STAGES:
            out = stage(spark, now, "")
            rows_ = out.collect()
            if name != "packing":
                assert out.columns == docs.columns, name
                now = spark.createDataFrame(rows_, docs.schema)
            assert bool(rows_) == (table is docs), name
