"""The log source: byte ranges, last lines of many files, streams that start again."""

import os

import pytest

from tidemark.sources import logs, tables


def put(path, data, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (at, at))


def values(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: (r["file"], r["at"]))]


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_ranges_give_each_line_once(spark, tmp_path, split):
    data = {"a": b"one\ntwo\n\nlonger line here\nend", "b": b"\n\n", "c": b"x\r\ny\r\n", "d": b"", "e": "é\n漢字\n".encode()}
    for i, (name, d) in enumerate(data.items()):
        put(tmp_path / "log" / name, d, 100 + i)
    put(tmp_path / "log" / "_hidden", b"no\n", 1)
    put(tmp_path / "log" / ".crc", b"no\n", 1)
    got = logs.log_lines(spark, str(tmp_path / "log"), split=split)
    assert values(got) == ["one", "two", "", "longer line here", "end", "", "", "x", "y", "é", "漢字"]


def test_last_lines_of_many_files(spark, tmp_path, monkeypatch):
    # the newest file is the largest, names are against the order of time
    for name, at, n in (("c", 100, 4), ("b", 200, 4), ("a", 300, 40)):
        put(tmp_path / "log" / name, "".join(f"{name}{i}\n" for i in range(n)).encode(), at)
    path = str(tmp_path / "log")
    tail = lambda n, **o: values(logs.log_lines(spark, path, n, split=16, **o))
    every = [f"{name}{i}" for name, n in (("c", 4), ("b", 4), ("a", 40)) for i in range(n)]
    for n in (1, 4, 40, 41, 46, 48, 100):
        assert sorted(tail(n)) == sorted(every[-n:]), n
    assert tail(0) == []
    assert tail(3, order="name") == ["c1", "c2", "c3"]
    monkeypatch.setattr(logs, "STEP", 5)
    assert sorted(x.split()[0] for x in tail(45)) == sorted(every[-45:])
    assert logs.log_lines(spark, str(tmp_path / "missing"), 3).count() == 0
    assert values(logs.log_lines(spark, str(tmp_path / "log" / "b"), 2)) == ["b2", "b3"]
    with pytest.raises(Exception, match="order"):
        logs.log_lines(spark, path, order="size").count()


def test_a_tail_reads_little(tmp_path):
    put(tmp_path / "log" / "old", b"x\n" * 1000, 1)
    put(tmp_path / "log" / "new", b"line\n" * 1_000_000, 2)
    parts = logs.LogReader({"path": str(tmp_path / "log"), "lines": "10"}).partitions()
    assert [(p.file.rsplit("/", 1)[-1], p.end - p.start) for p in parts] == [("new", 50)]


def test_malformed_lines_count_and_are_dropped(spark, tmp_path):
    put(tmp_path / "t" / "1", b'{"action":"generate"}\n{"action":"abstain","latency_ms":3,"other":[1]}\n', 1)
    put(tmp_path / "t" / "2", b'{broken\n[1]\n{"action":"hedge","latency_ms":"no number"}\n', 2)
    got = tables.read_recent(spark, str(tmp_path / "t"), 4)
    assert {(r["action"], r["latency_ms"]) for r in got.collect()} == {("abstain", 3.0), ("hedge", None)}
    raw = tables.parse_events(logs.log_lines(spark, str(tmp_path / "t"), 4), keep_raw=True)
    assert [r[0] for r in raw.filter("action = 'abstain'").selectExpr("try_variant_get(raw, '$.other[0]', 'int')").collect()] == [1]


def test_stream_starts_again_where_it_stopped(spark, tmp_path):
    path, out, point = (str(tmp_path / x) for x in ("log", "out", "point"))
    put(tmp_path / "log" / "a", b"1\n2\n3", 1)  # the third line isn't whole yet

    def run():
        q = logs.log_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", point).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    assert run() == ["1", "2"]
    with open(tmp_path / "log" / "a", "ab") as f:
        f.write(b"3\n4\n")
    put(tmp_path / "log" / "b", b"5\n", 3)
    assert run() == ["1", "2", "33", "4", "5"]
    assert run() == ["1", "2", "33", "4", "5"]
