"""Log sources on hand-written files: typed reading, quarantine, exports, repair, tailing."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from netweave.sources import logs, schemas, tail

HEADER = ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tdns", "#open\t2025-01-01", "#fields\t" + "\t".join(n for n, _ in schemas.fields("DNS")), "#types\t" + "\t".join(k for _, k in schemas.fields("DNS"))]


def dns(i, answers="a.example,::1", ttls="60.0,120.0", query="two words, one name"):
    return "\t".join([f"17000000{i:02d}.000000", f"C{i:016d}", "10.0.0.1", "5353", "10.0.0.2", "53", "udp", "7", "0.25", query, "1", "C_INTERNET", "28", "AAAA", "0", "NOERROR", "F", "F", "T", "-", "0", answers, ttls, "F"])


@pytest.fixture()
def log(tmp_path):
    folder = tmp_path / "pod-a"
    folder.mkdir()
    path = folder / "dns.log"
    broken = dns(5)[:60]
    short_ts = dns(6).replace("1700000006.000000", "1700000006.00000", 1)
    lines = [*HEADER, dns(1), dns(2, "-", "-"), dns(3, "(empty)", "60"), "", broken, short_ts, dns(7), "#close\t2025-01-02"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_read_log(spark, log):
    rows, bad = logs.read_log(spark, log, "DNS")
    got = {r.uid[-1]: r for r in rows.collect()}
    assert sorted(got) == ["1", "2", "3", "7"] and bad.count() == 2
    assert got["1"].answers == ["a.example", "::1"] and got["1"].TTLs == [60.0, 120.0] and got["1"].orig_p == 5353
    assert (got["1"].TC, got["1"].RD, got["1"].RA) == (False, True, None)
    assert got["2"].answers is None and got["3"].answers == [] and str(got["1"].ts) == "1700000001.000000"
    assert rows.drop("file", "pos").schema.simpleString() == schemas.schema("DNS").simpleString()


def test_lines_keep_their_order(spark, tmp_path):
    path = tmp_path / "weird.log"
    path.write_text("".join(f"line {i}\n" for i in range(2000)))
    got = [r.value for r in logs.read_lines(spark, str(path)).orderBy("file", "pos").collect()]
    assert got == [f"line {i}" for i in range(2000)]


def test_headers_may_differ_between_files(spark, tmp_path):
    names = [n for n, _ in schemas.fields("WEIRD")]
    for folder, fields in (("a", names), ("b", [*names[:6], "ip_proto", *names[6:]])):
        os.makedirs(tmp_path / folder)
        values = {"ts": "1700000001.000000", "uid": "C0123456789abcdef", "name": folder, "ip_proto": "6"}
        (tmp_path / folder / "weird.log").write_text("#fields\t" + "\t".join(fields) + "\n" + "\t".join(values.get(n, "-") for n in fields) + "\n")
    rows, bad = logs.read_log(spark, [str(tmp_path / x / "weird.log") for x in "ab"], "WEIRD")
    assert sorted(r.name for r in rows.collect()) == ["a", "b"] and bad.count() == 0
    lines = logs.with_log_type(logs.read_lines(spark, str(tmp_path / "a" / "weird.log")))
    assert lines.select("log_type", "pod").distinct().collect() == [("WEIRD", "a")]


def test_export_round_trip(spark, log, tmp_path):
    lines = logs.read_lines(spark, log).where(~F.col("value").startswith("1700000006.00000\t") & ((F.length("value") > 60) | F.col("value").startswith("#")))
    logs.write_export(lines.coalesce(1), "DNS", str(tmp_path / "csv"))
    part = next(p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv"))
    read = list(csv.reader(open(tmp_path / "csv" / part)))
    assert read[0] == [n for n, _ in schemas.fields("DNS")] and read[1] == dns(1).split("\t")
    typed = logs.read_export(spark, str(tmp_path / "csv"), "DNS")
    assert typed.count() == 4 and typed.where("query = 'two words, one name'").count() == 4


VALUES = {
    "time": ["1700000000.123456", "1699999999.000001"], "string": ["a b", "-", 'say "x", twice', "é,ü"], "addr": ["10.0.0.1", "fe80::1"], "port": ["443", "0"], "enum": ["tcp", "udp"],
    "interval": ["0.25", "-", "1e-06"], "count": ["0", "-", "123456789012"], "bool": ["T", "F", "-"], "vector[string]": ["a,b,a", "-", "(empty)", "one"], "vector[interval]": ["60.0,0.5", "-"], "set[string]": ["-", "x,x,y", "(empty)"], "set[enum]": ["(empty)", "-"],
}


@pytest.mark.parametrize("kind", ["CONN", "DNS", "HTTP", "SSL", "WEIRD"])
def test_logs_and_their_exports_say_the_same(spark, tmp_path, kind):
    """A log of every type, with unset, empty, quoted and comma-bearing values, against its CSV export, row by row."""
    fields = schemas.fields(kind)
    lines = []
    for i in range(24):
        row = [VALUES[k][(i + j) % len(VALUES[k])] for j, (_, k) in enumerate(fields)]
        row[1] = f"C{i:017d}"
        lines.append("\t".join(row))
    head = ["#separator \\x09", "#path\t" + kind.lower(), "#fields\t" + "\t".join(n for n, _ in fields), "#types\t" + "\t".join(k for _, k in fields)]
    log = tmp_path / f"{kind.lower()}.log"
    log.write_text("\n".join([*head, *lines, "#close\t2023"]) + "\n")
    rows, bad = logs.read_log(spark, str(log), kind)
    logs.write_export(logs.read_lines(spark, str(log)), kind, str(tmp_path / "csv"))
    typed = logs.read_export(spark, str(tmp_path / "csv"), kind)
    key = lambda r: tuple(map(str, r))
    assert bad.count() == 0 and rows.count() == len(lines)
    assert sorted(map(key, rows.drop("file", "pos").collect())) == sorted(map(key, typed.collect()))


def test_tags_and_repair(spark):
    line = F.lit("a\t\tb")
    got = spark.range(1).select(logs.csvify(logs.tokens(line), "SSL"), F.size(logs.tokens(line, collapse=True)), *logs.untag(F.lit("WEIRD,x,y"))).first()
    assert tuple(got) == ("SSL,a,,b", 2, "WEIRD", ["x", "y"])
    lines = spark.createDataFrame([("f", 1, "one"), ("f", 2, "two whole"), ("f", 3, "one"), ("f", 4, "other"), ("g", 1, "one")], "file string, pos long, value string")
    fragments = spark.createDataFrame([("f", "one", "two"), ("f", "one", "oth"), ("f", "one", "zzz"), ("g", "one", "x")], "file string, prev string, fragment string")
    got = {(r.file, r.fragment): r.repaired for r in logs.repair_lines(fragments, lines).collect()}
    assert got == {("f", "two"): "two whole", ("f", "oth"): "other", ("f", "zzz"): None, ("g", "x"): None}


def test_narrow_and_concat(spark, log):
    rows, _ = logs.read_log(spark, log, "DNS")
    assert logs.narrow(rows, "DNS").columns == schemas.NARROW["DNS"].split()
    both = logs.concat_logs(logs.read_lines(spark, log))
    assert both.where("part = 0").count() == 8 and both.where("value like '#close%'").count() == 0


def test_stretches_cover_each_line_once(tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"".join(b"%d" % (i**3) + b"x" * (i % 40) + b"\n" for i in range(500)) + b"partial")
    end = tail.last_line_end(str(path))
    want = path.read_bytes()[:end].decode().split("\n")[:-1]
    for step in (1 << 20, 97, 10):
        got = [line for at in range(0, end, step) for _, line in tail.lines_of(tail.Stretch(str(path), at, min(at + step, end), end))]
        assert got == want


def test_many_short_logs_are_few_tasks(tmp_path):
    for i in range(600):
        (tmp_path / f"pod-{i}").mkdir()
        (tmp_path / f"pod-{i}" / "conn.log").write_text(f"a{i}\nb{i}\n")
    reader = tail.TailReader({"paths": f"{tmp_path}/*/conn.log"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) == 3
    assert sorted((r[0], r[4]) for p in parts for r in reader.read(p)) == sorted((f"pod-{i}", f"{x}{i}") for i in range(600) for x in "ab")
    (tmp_path / "pod-0" / "conn.log").write_text("long\n" * 100)
    small = tail.TailReader({"paths": f"{tmp_path}/pod-0/conn.log,{tmp_path}/pod-1/conn.log", "taskbytes": "200"})
    parts = small.partitions(small.initialOffset(), small.latestOffset())
    assert [len(p.parts) for p in parts] == [1, 1, 2] and sum(1 for p in parts for _ in small.read(p)) == 102


def test_tail_follows_growing_files(spark, tmp_path):
    os.makedirs(tmp_path / "pod")
    path = tmp_path / "pod" / "conn.log"
    frame = tail.tail(spark, f"{tmp_path}/*/conn.log", taskbytes="64")
    query = frame.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for text in ("", "first\nsec", "ond\n", "third\nfourth\nfif", "th\n"):
            with open(path, "a") as f:
                f.write(text)
            query.processAllAvailable()
        assert [r.value for r in spark.table("tailed").orderBy("pos").collect()] == ["first", "second", "third", "fourth", "fifth"]
        assert {r.source for r in spark.table("tailed").collect()} == {"pod"}
    finally:
        query.stop()
    tail.replay(["sixth"], str(path))
    again = tail.tail(spark, f"{tmp_path}/*/conn.log").writeStream.format("memory").queryName("tailed2").option("checkpointLocation", str(tmp_path / "check2")).start()
    try:
        again.processAllAvailable()
        assert spark.table("tailed2").count() == 6
    finally:
        again.stop()


def _values(spark, folder):
    return [r.value for r in spark.read.parquet(str(folder)).orderBy("value").collect()]


def test_tail_across_rotation(spark, tmp_path):
    """Renamed, replaced, cut short and late files, with a restart before each step: every line once."""
    (tmp_path / "pod").mkdir()
    log = tmp_path / "pod" / "conn.log"

    def run():
        frame = tail.tail(spark, f"{tmp_path}/*/*.log", taskbytes="20")
        query = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return _values(spark, tmp_path / "out")

    log.write_text("a1\na2\n")
    assert run() == ["a1", "a2"]
    with log.open("a") as f:
        f.write("a3\na4 its end is not there y")
    assert run() == ["a1", "a2", "a3"]
    with log.open("a") as f:
        f.write("et\na5\n")
    log.rename(tmp_path / "pod" / "conn.2024.gz.old")  # what was written after the last look is read first
    log.write_text("b1\nb2\n")
    (tmp_path / "pod" / "dns.log").write_text("d1\n")
    assert run() == ["a1", "a2", "a3", "a4 its end is not there yet", "a5", "b1", "b2", "d1"]
    with log.open("w") as f:  # the same file, cut short
        f.write("c1\n")
    assert run()[-3:] == ["b2", "c1", "d1"]
    assert len(run()) == 9
    log.rename(tmp_path / "away")  # another folder: the rest is lost, with a warning
    log.write_text("e1\n")
    assert run()[-1] == "e1"
    made = {r.made for r in spark.read.parquet(str(tmp_path / "out")).where("file like '%conn.log'").collect()}
    assert len(made) == 3


def test_tail_gives_up_on_a_log_that_never_appears(tmp_path):
    reader = tail.TailReader({"paths": f"{tmp_path}/*.log", "wait": "0.05"})
    assert reader.latestOffset() == {"files": "{}"}
    import time

    time.sleep(0.1)
    with pytest.raises(TimeoutError, match="no file"):
        reader.latestOffset()
    (tmp_path / "conn.log").write_text("x\n")
    assert "conn.log" in tail.TailReader({"paths": f"{tmp_path}/*.log", "wait": "0.05"}).latestOffset()["files"]
    assert tail.TailReader({"paths": f"{tmp_path}/none*.log"}).latestOffset() == {"files": "{}"}


def test_command_line(spark, log, tmp_path):
    from netweave.__main__ import main

    main(["replay", log, str(tmp_path / "copy.log"), "-d", "0"])
    assert open(tmp_path / "copy.log").read() == open(log).read()
    main(["export", log, str(tmp_path / "out"), "--type", "DNS"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6
    main(["query", "class_balance", "/root/testdata/sf0.001", "--out", str(tmp_path / "rows")])
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1


def test_profiles_of_log_types(spark, log):
    from netweave.operators.profile import PROFILED, log_profile

    rows, _ = logs.read_log(spark, log, "DNS")
    got = {(r.section, r.item): r.value for r in log_profile(logs.with_log_type(rows), "pod", *PROFILED["DNS"]).collect()}
    assert got["rtt", "mean"] == 0.25 and got["rejected", "ratio"] == 0.0 and got["qtype_name", "AAAA"] == 1.0
    for kind, (numbers, categories, flags) in PROFILED.items():
        assert {*numbers, *categories, *flags} <= set(schemas.schema(kind).names)


def test_tailed_rows_come_in_arrow_batches(tmp_path, monkeypatch):
    """The same rows as one by one; logs that did not grow are not opened again."""
    for i in range(3):
        (tmp_path / f"pod-{i}").mkdir()
        (tmp_path / f"pod-{i}" / "conn.log").write_bytes(b"".join(b"line %d \xc3\xa9 \xff\n" % j for j in range(50)) + b"no end")
    monkeypatch.setattr(tail, "BATCH_ROWS", 60)
    options = {"paths": f"{tmp_path}/*/conn.log"}
    plain, batches = tail.TailReader(options), tail.LogTail(options).streamReader(None)
    parts = plain.partitions(plain.initialOffset(), plain.latestOffset())
    found = [b for p in parts for b in batches.read(p)]
    assert [b.num_rows for b in found] == [60, 60, 30]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [r for p in parts for r in plain.read(p)]
    ended = tmp_path / "pod-0" / "conn.log"
    with ended.open("ab") as f:
        f.write(b"\n")
    looked, look = [], tail.last_line_end
    monkeypatch.setattr(tail, "last_line_end", lambda file: looked.append(file) or look(file))
    first = plain.latestOffset()
    assert len(looked) == 3 and plain.latestOffset() == first and looked.count(str(ended)) == 1
    with ended.open("ab") as f:
        f.write(b"more\n")
    assert plain.latestOffset() != first and looked.count(str(ended)) == 2
