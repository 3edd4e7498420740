"""Tensored minhashing, token alignment and burst tries against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import align, minhash, trie

WORDS = [a + b for a in "alpha beta gamma delta epsilon zeta eta theta".split() for b in "0 1 2 3 4 5 6 7 8 9".split()]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else ({tuple(w)} if w else set())


def chains():
    """Texts whose links form chains: copies with edits of a base, edits of those, passages that many share, and odd rows."""
    r = np.random.default_rng(5)
    prose = lambda n: r.choice(WORDS, n).tolist()
    out = []
    for group in range(6):
        base = prose(int(r.integers(60, 300)))
        last = base
        for k in range(14):
            last = list(base if k % 3 else last)
            for at in r.integers(0, len(last), max(1, len(last) // 90)):
                last[at] = str(r.choice(WORDS)) + "x"
            out.append(" ".join(last).upper() if k % 2 else "\n".join(last))
        shared = prose(120)
        out += [" ".join(prose(int(n)) + shared) for n in r.integers(5, 120, 14)]
    out += ["one two", "One  TWO", "one two three four five", "one two three four five six", None, "", " \n\t", "É a b c d e", "é a b c d e", " ".join(prose(20_000))]
    return out


@pytest.mark.parametrize("chunk, together", [(1024, 4096), (3, 4096), (3, 0)])
def test_minhash_components(spark, monkeypatch, chunk, together):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "TOGETHER", together)
    texts = chains()
    texts += texts[3:5]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), links)
    assert len(set(want.values())) < len(texts) - 40
    docs = spark.createDataFrame([(i, t, "own", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string, node double")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_minhash_rest_finds_what_stars_miss(spark, monkeypatch):
    """Links that comparing with one member of a bucket can't see are found in the groups that are left."""
    seen = []
    rest = minhash.rest

    def counted(*a):
        seen.append(rest(*a).count())
        return rest(*a)

    monkeypatch.setattr(minhash, "rest", counted)
    docs = spark.createDataFrame(list(enumerate(chains())), "doc_id long, text string")
    minhash.near_components(docs)
    assert seen[0] > 0


def test_minhash_blocks_of_shingles(monkeypatch):
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 64, 2000, np.uint64))
    sets = [np.sort(np.concatenate((base[k:], r.integers(0, 1 << 64, 3 * k, np.uint64)))) for k in (0, 20, 40, 60, 80, 300)]
    few = minhash.forest(sets, np.arange(6), np.zeros(6, int))
    # the same in blocks of one word
    monkeypatch.setattr(minhash, "BLOCK_WORDS", 6)
    blocks = minhash.forest(sets, np.arange(6), np.zeros(6, int))
    linked = [(i, j) for i in range(6) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert components(range(6), few) == components(range(6), blocks) == components(range(6), linked)
    assert not minhash.forest(sets, np.array([0, 0, 0, 0, 0, 5]), np.zeros(6, int))


def test_minhash_odd_rows(spark):
    docs = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand in this text"), (None, "A b c d e f"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect())
    assert got == Counter({(7, 2, 7): 3, (None, 2, 7): 1, (None, 1, None): 1, (None, 0, None): 1})
    assert not minhash.near_components(docs.limit(0)).collect()


TEXTS = ["the Quick  brown fox", "", None, " ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "\x00nul", "ﬁ ² 漢字 🎉\n\n  x", "a" * 3000, "é​ \r\n\t", "the Quick  brown fox", "naïve façade, don't!　ok", "word " * 4000]


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_alignment(spark, rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=align.piece_path())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}

    def tokens(text):
        a, b = left.encode(" " + text, add_special_tokens=False), right.encode(text)
        pieces = [right.id_to_piece(i) for i in b]
        bytes_ = [[bytes(letters[c] for c in t) for t in a.tokens], [bytes([int(p[3:-1], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]]
        return (a.ids, b, *bytes_) if text and all(b"".join(x) == (" " + text).encode() for x in bytes_) else ([], [], [], [])

    each = []
    for text in TEXTS:
        a, b, bytes_a, bytes_b = tokens(text or "")
        owner = [[k for k, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]  # of each byte
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append([",".join(str(ids[k]) for k in sorted(set(o[at:end]))) for ids, o in zip((a, b), owner)])
            at = end
        each.append((a, b, groups, [(a[i], b[j]) for i, j in sorted(set(zip(*owner)))]))
    count = Counter(p for e in each for p in set(e[3]))
    best = {a: max(c for (x, _), c in count.items() if x == a) for a, _ in count}
    want = [
        (i, len(a), len(b), len(g), len(l), sum(count[p] == best[p[0]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if a else "")
        for i, (a, b, g, l) in enumerate(each)
    ]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string, uid int")
    assert sorted(tuple(r) for r in align.alignment(docs, broadcast_rows=rows).collect()) == want
    assert want[5][1] == 0 and want[0][1] > 0  # U+2581 in a text is no space
    assert not align.alignment(docs.limit(0)).collect()


def test_pointer_jumping():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 200))
        a, b = (np.unique(np.append(r.integers(1, n + 1, int(r.integers(0, n))), n)) for _ in range(2))
        both = np.intersect1d(a, b)
        got = align.groups(a, b)
        assert (got[0] == np.searchsorted(both, a)).all() and (got[1] == np.searchsorted(both, b)).all()


def conversations():
    r = np.random.default_rng(3)
    rows = []
    for c in range(60):
        for t in range(int(r.choice([0, 1, 2, 3, 5, 12, 30]))):
            rows.append((c, None if c % 7 == 0 and r.random() < 0.3 else t, "user" if c < 50 else r.choice(["user", "tool"]).item(), r.choice(["a", "a", "bé", ""]).item() if t < 3 else f"a common turn {t}"))
    rows += [(5, 1, "user", "a"), (5, 1, "user", "a"), (None, 1, "user", "x"), (1000, 0, None, None), (1001, None, "", "late"), (1001, 7, "user", None)]
    return rows + [(100 + c, t, "user", f"same {t}") for c in range(10) for t in range(15)]


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, d == len(whole)))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p for q in below if len(q) == len(p) + 1) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c, e in members if e)))
        out.append((min(members)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("burst, size", [(4096, 1 << 25), (5, 1 << 25), (1, 1 << 25), (4096, 200)])
def test_trie(spark, burst, size):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("own"), "seq": F.lit(1)})
    assert Counter(tuple(r) for r in trie.nodes(table, burst, size).collect()) == brute_trie(rows)


def test_trie_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "hello") for c in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in trie.nodes(table).collect()) == brute_trie(rows)
    assert not trie.nodes(table.limit(0)).collect()
