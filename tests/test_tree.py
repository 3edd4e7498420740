"""Trees on disk: scans, links hop by hop, and what lies beyond them, against what the system says."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import links, select
from corpusloom.sources import tree


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    t = tmp_path_factory.mktemp("tree")
    for d in ("r/a/b", "r/empty", "x/deep/er", "y"):
        os.makedirs(t / d)
    for f, text in (("r/a/f1", "one"), ("r/a/b/f2", ""), ("x/f3", "three"), ("x/deep/er/f4", "4"), ("y/f5", "5")):
        (t / f).write_text(text)
    os.chmod(t / "r/a/f1", 0o640)
    os.utime(t / "r/a/f1", ns=(5, 7_000_000_001))
    os.link(t / "r/a/f1", t / "r/hard")
    named = [("up", "../x/f3"), ("broken", "nowhere"), ("c1", "c2"), ("c2", "./c1"), ("self", "self"), ("dir", "../x/deep"), ("chain", "up"), ("abs", str(t / "r/a")), ("through", "dir/er/f4"), ("chain2", "chain"), ("gone", "dir/er/f9")]
    for name, target in named:
        os.symlink(target, t / "r" / name)
    os.symlink("../../../y", t / "x/deep/er/back")
    os.symlink(t / "r/dir/er/f4", t / "y/mid")
    os.mkfifo(t / "r/pipe")
    return t


@pytest.fixture(scope="module")
def entries(spark, top):
    return tree.scan_tree(spark, [f"{top}/r", f"{top}/x/", f"{top}/y"], directories=True).cache()


def below(top, rows):
    cut = lambda v: v.removeprefix(str(top)) if isinstance(v, str) else v
    return sorted((tuple(map(cut, r)) for r in rows), key=str)


@pytest.mark.parametrize("budget", [2])
def test_scan(spark, top, budget):
    got = tree.scan_tree(spark, [str(top / p) for p in ("r", "x", "y", "r/a", "none", "y/f5", "r/up")], budget=budget).collect()
    want = {str(top / "none"): "absent"}
    for home, _, names in os.walk(top):
        for p in (os.path.join(home, n) for n in [*names, *os.listdir(home)]):
            if os.path.islink(p) or os.path.isfile(p):
                want[p] = "link" if os.path.islink(p) else "file"
    assert {r.path: r.kind for r in got} == want and len(got) == len(want)
    for r in got:
        if r.kind in ("file", "link"):
            st = os.lstat(r.path)
            assert (r.size, r.mode, r.inode, r.n_links, r.mtime_ns, r.changed_ns) == (st.st_size, st.st_mode & 0o7777, st.st_ino, st.st_nlink, st.st_mtime_ns, st.st_ctime_ns)
            assert r.target == (os.readlink(r.path) if r.kind == "link" else None)


def test_scan_prunes_and_reports(spark, top):
    got = {r.path for r in tree.scan_tree(spark, [str(top)], prune=[str(top / "r/a"), str(top / "x/deep")]).collect()}
    assert str(top / "x/f3") in got and not any("/r/a/" in p or "/deep/" in p for p in got)
    odd = [r for r in tree.walk([str(top / "y/f5")], frozenset(), False, True, 10)]
    assert [(r[1], r[-1]) for r in odd] == [("error", "Not a directory")]


def test_bytes_and_info(spark, top, entries):
    files = entries.filter("kind <> 'directory'")
    got = {r.path.removeprefix(str(top)): r.content for r in tree.read_bytes(files.select("path", "kind"), most=4).collect()}
    assert (got["/r/a/f1"], got["/r/a/b/f2"], got["/x/f3"], got["/r/up"]) == (b"one", b"", None, b"../x/f3")
    info = {r.path.removeprefix(str(top)): r for r in select.info(files).collect()}
    assert (info["/r/a/f1"].modified, info["/r/a/f1"].permissions, info["/r/up"].type) == ("1970-01-01T00:00:07Z", "-rw-r-----", "symlink")
    assert info["/r/a/f1"].created > "2020"


def test_hops(top, entries):
    got = {}
    for path, hop, place, kind, state in below(top, links.hops(entries.filter("kind = 'link'"), entries).collect()):
        got.setdefault(path, []).append((hop, place, kind, state))
    assert {p: sorted(h) for p, h in got.items()} == {
        "/r/abs": [(1, "/r/a", "directory", "resolved")], "/r/broken": [(1, "/r/nowhere", "absent", "broken")], "/r/self": [(1, "/r/self", "link", "cycle")],
        "/r/c1": [(1, "/r/c2", "link", "cycle"), (2, "/r/c1", "link", "cycle")], "/r/c2": [(1, "/r/c1", "link", "cycle"), (2, "/r/c2", "link", "cycle")],
        "/r/chain": [(1, "/r/up", "link", "resolved"), (2, "/x/f3", "file", "resolved")], "/r/up": [(1, "/x/f3", "file", "resolved")],
        "/r/chain2": [(1, "/r/chain", "link", "resolved"), (2, "/r/up", "link", "resolved"), (3, "/x/f3", "file", "resolved")],
        "/r/dir": [(1, "/x/deep", "directory", "resolved")], "/r/through": [(1, "/r/dir/er/f4", "file", "resolved")], "/r/gone": [(1, "/r/dir/er/f9", "absent", "broken")],
        "/x/deep/er/back": [(1, "/y", "directory", "resolved")], "/y/mid": [(1, "/r/dir/er/f4", "file", "resolved")],
    }


def test_long_chains_and_loops(spark):
    links_ = [(f"/l/{i}", "link", str(i + 1)) for i in range(100)] + [("/l/100", "file", None)]
    links_ += [(f"/m/{i}", "link", f"../m/{i + 1 if i < 40 else 30}") for i in range(41)]
    links_ += [("/p/a", "link", "b/x"), ("/p/b", "link", "a/y")]  # directories that lead into each other
    entries = spark.createDataFrame(links_, "path string, kind string, target string")
    rows = links.hops(entries.filter("kind = 'link'"), entries).collect()
    n = lambda p: sorted((r.hop, r.place, r.state) for r in rows if r.path == p)
    assert n("/l/0") == [(i, f"/l/{i}", "resolved") for i in range(1, 101)]
    assert n("/m/0") == [(i, f"/m/{i}", "cycle") for i in range(1, 41)]
    assert n("/m/35") == [(k + 1, f"/m/{p}", "cycle") for k, p in enumerate([36, 37, 38, 39, 40, 30, 31, 32, 33, 34, 35])]
    assert n("/p/a") == [(1, "/p/b/x", "broken")]


def test_follow(top, entries):
    got = {(p, b, v) for p, _, b, v in below(top, links.follow(entries, str(top / "r")).collect())}
    own = {(p, "/r", None) for p in ("/r/a/b/f2", "/r/a/f1", "/r/hard", *(f"/r/{n}" for n in "abs broken c1 c2 chain chain2 dir gone self through up".split()))}
    far = {("/x/f3", None, "/r/chain"), ("/x/deep/er/back", "/x/deep", "/r/dir"), ("/x/deep/er/f4", "/x/deep", "/r/dir"), ("/y/f5", "/y", "/x/deep/er/back"), ("/y/mid", "/y", "/x/deep/er/back"), ("/r/dir/er/f4", None, "/y/mid")}
    assert got == own | far
    wanted = lambda p, rel: select.include(p, rel, ["f*", "er/*"])
    few = below(top, links.follow(entries, f"{top}/r", wanted, lambda p, rel: select.exclude(p, rel, [f"{top}/y", "a/b"])).collect())
    assert {r[0] for r in few} == {"/r/a/f1", "/x/f3", "/x/deep/er/f4", "/x/deep/er/back"}


def test_base_that_is_a_link(spark):
    rows = [("/r/l", "link", "/s/d"), ("/s/d", "link", "/t"), ("/t/f", "file", None), ("/t", "directory", None), ("/r", "directory", None), ("/s", "directory", None)]
    got = links.follow(spark.createDataFrame(rows, "path string, kind string, target string"), "/r").select("path", "base").collect()
    assert {tuple(r) for r in got} == {("/r/l", "/r"), ("/s/d", None), ("/t/f", "/t")}
    assert links.follow(spark.createDataFrame(rows, "path string, kind string, target string"), "/s/d").filter(F.col("path") == "/s/d/f").count() == 1


def test_remove_tree(spark, tmp_path):
    """All goes, by tasks; what links lead to stays."""
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "f").write_text("x")
    for i in range(200):
        (tmp_path / "t" / f"d{i % 3}" / "e").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / f"d{i % 3}" / "e" / f"{i}").write_text("x")
    (tmp_path / "t" / "dir").symlink_to(tmp_path / "kept")
    (tmp_path / "t" / "file").symlink_to(tmp_path / "kept" / "f")
    tree.remove_tree(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists() and (tmp_path / "kept" / "f").read_text() == "x"
    tree.remove_tree(spark, str(tmp_path / "none"))
