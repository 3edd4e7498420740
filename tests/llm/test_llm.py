"""Each operator on small fixtures with odd rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bytededup, htmltext, langid, licenses, linededup, mixing, neighbours, packing, quality, simhash

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n).tolist())


A, B = prose(1, 120), prose(2, 90)
#: null and empty texts, white space only, copies, a near copy, repeated rows, a null id, a shared passage, a long text.
DOCS = [
    (1, A, "en", "s1"), (2, A, "en", "s1"), (3, A.replace("gamma", "GAMMA", 1) + " tail", "en", None), (4, None, None, "s2"), (5, "", "de", "s2"), (6, " \n\t\n", "de", "s3"),
    (7, B + "\nGNU General Public License and cc-by, cc by\n\n" + B, "fr", "s1"), (7, B + "\nGNU General Public License and cc-by, cc by\n\n" + B, "fr", "s1"), (None, "x y", "fr", "s3"), (9, "\n\n" + prose(3, 30) + "\n" + B, "en", "s1"),
    (10, "<|endoftext|> is text ² ½ \x1c Ü 漢字 " + prose(4, 20), "en", ""), (11, prose(5, 4000), "en", "s1"), (12, "one two", "en", "s4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({"d": F.lit(1), "k1": F.lit("own"), "n_words": F.lit("own"), "fp": F.lit(2.5), "h": F.lit(0)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_quality(docs, none):
    got = quality.ledger(docs).collect()
    assert len(got) == len(DOCS) and not quality.ledger(none).collect()
    for r, (_, text, *_rest) in zip(got, DOCS):
        w = words(text)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r.n_repeat_words == len({i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)})
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
    table = {r.rule: r for r in quality.ablation(quality.ledger(docs), "v1").collect()}
    assert table["too_short"].n_failed == sum(len(words(t)) < 20 for _, t, *_x in DOCS)
    kept = sum(r.fail_bits == 0 for r in got)
    assert all(r.n_kept == kept and r.n_kept_without == kept + r.n_failed_alone for r in table.values())


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8)).astype("float32")
    x[50:90] = x[50]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [None] * 8), (800, [1.0]), (100, x[100].tolist()), (None, x[3].tolist())]
    got = {}
    for q in neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    assert sorted(got) == list(range(0, 400, 50))
    y, ids = np.vstack((x, x[100:101])).astype(float), np.array([*range(400), 100])  # of vector 100 there are two rows
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [f[0] for f in found] == ids[best].tolist() and np.allclose([f[1] for f in found], d[best], rtol=1e-12)
    assert not neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect()


def test_language(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table.filter(~langid.held_out("doc_id")))
    got = langid.predict(table, model, ["doc_id", "lang"]).filter(langid.held_out("doc_id")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = langid.predict(docs, model).collect()
    assert len(odd) == len(DOCS) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for r, (_, t, *_x) in zip(odd, DOCS))
    assert not langid.predict(none, model).collect() and langid.train(none).langs == []
    assert langid.predict(docs, langid.train(none)).first().lang_pred == "und"
    long = langid.normalize("der und die " * 40_000)
    whole, parts = model.log_probs(np.concatenate((np.zeros(langid.ORDER, np.uint32), long)))[langid.ORDER :].sum(axis=0, dtype=float), -model.cross_entropies([long])[0] * len(long)
    assert np.allclose(whole, parts, rtol=1e-3)


def test_kneser_ney_sums_to_one(spark):
    model = langid.train(spark.createDataFrame([(i, "xx", t) for i, t in enumerate(["abab cab", "bca abc", "ccba ab a", "bab cac"] * 3)], "doc_id long, lang string, text string"))
    letters = [ord(c) for c in "abc "]
    for context in ("ab", "ca", "zz"):
        total = sum(float(np.exp(model.log_probs(np.array([32, *map(ord, context), c], np.uint32))[-1, 0])) for c in letters)
        assert 0.6 < total <= 1.0001


def test_licenses(docs, none):
    got = licenses.scan(docs).collect()
    assert len(got) == len(DOCS) and not licenses.scan(none).collect()
    for r in got:
        w = licenses.split_words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x[1] for x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    s = docs.sparkSession
    more = licenses.scan(s.createDataFrame([("Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files",), ("Licensed under CC BY-NC 4.0.",)], "text string")).collect()
    assert [r.labels for r in more] == ["mit-notice", "cc-by,cc-by-nc-4.0"]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs).collect()
    want = Counter()
    for i, text, *_ in DOCS:
        ids = np.array(tk.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in rows.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(rows) == -(-sum(r.length for r in got) // 1024) and not packing.pack(none).collect()


def test_bounds():
    r = np.random.default_rng(3)
    for high in (200, 700, 1024):
        x = r.integers(1, high, 300)
        bins, offsets, left = packing.best_fit(x)
        assert packing.lower_bound(x) <= len(left) and (np.bincount(bins, weights=x) <= 1024).all() and (1024 - np.bincount(bins, weights=x) == left).all()
    assert packing.lower_bound(np.full(5, 600)) == 5 and packing.lower_bound(np.array([400, 400, 700, 700])) == 3


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and not mixing.mix(none).collect()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.first_position is None) == (r.taken == 0)
    sizes = Counter()
    for _, t, _, s in DOCS:
        sizes[s] += len(words(t))
    goal = {}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    open_, rest = set(order), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            break
        goal |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2 * sizes[s] for s in full)
        open_ -= full
    goal |= {s: level * weights[s] for s in open_}
    assert sorted(round(r.target, 6) for r in got) == sorted(round(goal[s], 6) for *_, s in DOCS)
    assert abs(sum(r.taken for r in got) - sum(goal.values())) <= len(sizes)


def test_lines(spark, docs, none):
    rows = [(1, "a b\nc d\ne f\ng"), (2, "x\n a b \nc d\ny\n\n"), (3, "c d\ne f\n\ng\nz"), (4, "p\np\np\np"), (5, " ".join("abcdefghijk")), (6, "q\n" + " ".join("abcdefghijk")), (7, None), (8, ""), (9, "\n\na b\nc d")]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a b\nc d\ne f\ng", 2: "x\ny\n\n", 3: "z", 4: "p", 5: " ".join("abcdefghijk"), 6: "q", 7: None, 8: "", 9: "\n"}
    out = linededup.dedup(docs, report=True).collect()
    assert len(out) == len(DOCS) and not linededup.dedup(none).collect() and out[0].d == 1
    assert {r.doc_id: r.text for r in out}[2] == ""


def brute_bytes(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, m in zip(t, mask) if not m)
        yield len(t), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


def test_bytes(spark, docs, none):
    r = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    p, q = noise(230), noise(199)
    extra = ["é" * 150, "ab" * 300, p + noise(50), noise(40) + p, noise(33) + p[:205] + noise(60), q + "1", q + "2", noise(400), "z" * 500, "zz" * 90]
    extra += [noise(20) + p[10:215] + noise(9) for _ in range(6)]
    rows = [(i, t) for i, t, *_ in DOCS] + [(100 + i, t) for i, t in enumerate(extra)]
    got = bytededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = list(brute_bytes([(t or "").encode() for _, t in rows]))
    assert Counter((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == Counter(want)
    assert not bytededup.remove_repeats(none).collect()


def brute_fingerprint(text):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_simhash(docs, none):
    got = simhash.near_components(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((i, brute_fingerprint(t)) for i, t, *_ in DOCS)
    assert not simhash.near_components(none).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[4] == by[5] == by[6] == 4
    kept = [r.doc_id for r in simhash.dedup(docs).collect()]
    assert kept.count(7) == 1 and 2 not in kept and None in kept


def test_links_of_fingerprints():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 5) for _ in range(3)]))
    group = np.sort(r.integers(0, 3, len(fp)))
    i, j = simhash.links(group, fp, np.zeros(len(fp), np.int32))

    def classes(pairs):
        root = list(range(len(fp)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(fp))]

    want = [(a, b) for a in range(len(fp)) for b in range(a) if group[a] == group[b] and bin(int(fp[a] ^ fp[b])).count("1") <= 3]
    assert classes(zip(i.tolist(), j.tolist())) == classes(want)
    assert all(bin(int(fp[a] ^ fp[b])).count("1") <= 3 for a, b in zip(i, j))


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/x">menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p>One <b>two</b><br>three<p>four\n five&nbsp;six<script>if (a < b) {}</script><div class="comments">me too</div></article><!-- c --><footer>f</footer>'
    plain = "<body><div><p>menu one</p></div><p>Story {0} begins.</p><p>It ends &copy; {0}.</p><div>legal text</div></body>"
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "http://a.example/3", ""), (4, "http://a.example/4", "<p>open <i>tags &am & <unknown>x</unknown>")] + [(10 + i, f"http://b.example/{i}", plain.replace("{0}", str(i))) for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k1", F.lit(1))).collect()}
    assert got[1] == "Head & line\nOne two three\nfour five six" and got[2] == got[3] == "" and got[4] == "open tags &am & x"
    assert got[12] == "Story 2 begins.\nIt ends © 2."


def test_html_copies(spark):
    nav = "<div><p>menu one</p></div>"
    plain = f"<body>{nav}<p>Story {{0}} begins.</p><p>It ends {{0}}.</p></body>"
    wrapped = f"<body>{nav}<div class=x><article><p>Piece {{0}}.</p><ul><li>a list</li></ul><div>a box</div></article></div><p>{{1}}</p></body>"
    rows = [(f"http://a/{i}", plain.format(0)) for i in range(8)] + [(f"http://a/{i}", plain.format(i)) for i in range(8, 16)]  # copies under several urls
    rows += [("http://b/1", plain.format(1))] * 9 + [(None, wrapped.format(1, "x"))] * 7  # hosts of copies only
    rows += [(f"http://c/{i}", wrapped.format(1, f"version {i}")) for i in range(6)] + [(f"http://c/{i}", wrapped.format(i, "x").replace("a list", f"list {i}")) for i in range(6, 12)]  # variants
    rows += [(f"http://d/{i}", plain.format(i % 7 // 6).replace("<body>", f"<body><!-- {i} -->")) for i in range(14)] + [(f"http://d/{i}", plain.format(i)) for i in range(14, 20)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(table).collect()}
    piece = lambda i, a="a list": f"Piece {i}.\n{a}\na box"
    want = [f"Story {i} begins.\nIt ends {i}." for i in [0] * 8 + list(range(8, 16))] + ["menu one\nStory 1 begins.\nIt ends 1."] * 9 + [piece(1)] * 7
    want += [piece(1)] * 6 + [f"Piece {i}.\nlist {i}" for i in range(6, 12)] + [f"Story {i % 7 // 6} begins.\nIt ends {i % 7 // 6}." for i in range(14)] + [f"Story {i} begins.\nIt ends {i}." for i in range(14, 20)]
    want[32:38] = ["Piece 1.\na list"] * 6  # the box is on different pages, the list only on variants of one
    assert [got[i] for i in range(len(rows))] == want


def test_html_hot_host(spark):
    """What 500 different pages have is template however many pages the host has; what 500 copies have is not."""
    rows = [(i, f"http://a/{i}", f"<body>{'<div>strike today</div>' if i < 500 else '<div>a quote</div>' if i < 1100 else ''}<p>Story {i if i < 500 or i >= 1100 else 'copied'}.</p></body>") for i in range(3800)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Story 7." and got[3000] == "Story 3000." and got[700] == "a quote\nStory copied."


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 100, name
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
