"""Queries over streams and formats, held against their SQL on the smallest tables."""

import duckdb
import pytest

from corpusloom.plans import stream_queries
from corpusloom.sources import arrivals
from corpusloom.streaming import actions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_sink", "ordered_stream", "grep_binary", "edit_all", "snapshot_names"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = stream_queries.QUERIES[name](spark, SF)
    cursor = con.execute(stream_queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = [tuple(r) for r in df.select(*names).collect()], cursor.fetchall()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def test_arrivals_by_slices(spark, tmp_path):
    """Tasks deal out what is new, and not the driver: no task for each file. What has come stays known when a stream goes on."""
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    for i in range(300):
        (source / "sub" / f"{i}.txt").write_text(str(i))
    (source / "_hidden").write_text("x")
    (source / "empty").write_text("")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "moved.txt").write_text("older than the stream")

    def run():
        q = actions.arriving(spark, str(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).select("path").collect())

    first = run()
    assert first == sorted(str(source / "sub" / f"{i}.txt") for i in range(300))
    assert run() == first
    (tmp_path / "old").rename(source / "old")  # files in it are as old as before
    (source / "sub" / "1.txt").write_text("again")
    assert run() == sorted([*first, str(source / "old" / "moved.txt")])
    assert run() == sorted([*first, str(source / "old" / "moved.txt")])


def test_arrivals_that_run_again(tmp_path):
    """A batch that runs again gives what its log says, whatever came since; a log that is gone is an error."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1")
    reader = arrivals.ArrivalsReader({"directory": str(tmp_path / "in"), "log": str(tmp_path / "log"), "slices": "3"})
    read = lambda start, end: sorted(p for s in reader.partitions(start, end) for b in reader.read(s) for p in b.column(0).to_pylist())
    start, end = reader.initialOffset(), reader.latestOffset()
    assert read(start, end) == [str(tmp_path / "in" / "a")] and reader.latestOffset() == end
    (tmp_path / "in" / "b").write_text("2")
    assert read(start, end) == [str(tmp_path / "in" / "a")]
    reader = arrivals.ArrivalsReader({"directory": str(tmp_path / "in"), "log": str(tmp_path / "log"), "slices": "5"})
    assert read(end, later := reader.latestOffset()) == [str(tmp_path / "in" / "b")]
    reader.commit(later)
    with pytest.raises(RuntimeError, match="is gone"):
        reader.partitions({"log": str(tmp_path / "log" / "none"), "slices": 3, "names": [1, 1]}, end)
