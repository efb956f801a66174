"""Logs split over batches against one run over the whole logs; repeated batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from logwarden.operators.classify import classify_events
from logwarden.operators.incidents import build_incidents, incident_parts, incidents_of, merge_parts
from logwarden.operators.iocs import log_iocs
from logwarden.plans.log_run import process_lines
from logwarden.sources.logs import log_lines
from logwarden.sources.tables import event_rows
from logwarden.streaming import piece_stream as P


def logs():
    rng = random.Random(13)
    ssh = lambda i: rng.choice([
        f"Jul  1 10:{i % 60:02d}:11 host{i % 3} sshd[{i}]: Failed password for root from 185.24.18.{i % 9} port 5{i % 10}431 ssh2",
        f"Jul  1 10:{i % 60:02d}:12 host{i % 3} sudo: bob : TTY=pts/0 ; PWD=/home/bob ; USER=root ; COMMAND=/bin/cat /etc/shadow",
        "", "no log line at all"])
    web = lambda i: f'185.1.2.{i % 7} - bob [01/Jul/2025:10:23:{i % 60:02d} +0000] "GET /a?id=1%20UNION%20SELECT%20{i % 3} HTTP/1.1" 200 12 "-" "Mozilla/5.0"'
    return {"ssh.log": [ssh(i) for i in range(120)], "web.log": [web(i) for i in range(95)], "short.log": [ssh(i) for i in range(20)],
            "late.log": ["", "  "] * 10 + [ssh(i) for i in range(70)]}


def cut(lines, at):
    cuts = [0, *sorted(len(lines) * k // 100 for k in at), len(lines)]
    return [lines[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


EVENT = ("log", "line_number", "event_type", "source_ip", "severity_score", "raw_line")
IOC = ("log", "ioc_type", "value", "line_number", "source_field", "event_count")
INCIDENT = ("log", "title", "severity", "event_type", "event_count", "ioc_count", "mitre_techniques", "mitre_tactics", "source_ips", "affected_hosts")


def named(df, names, columns):
    rows = df.join(names, "log_id").select(*columns).collect()
    return sorted(str(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def whole(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(logs())], "log_id long, log string")
    files = spark.createDataFrame([(i, "".join(x + "\n" for x in lines)) for i, lines in enumerate(logs().values())],
                                  "log_id long, content string")
    events = event_rows(process_lines(log_lines(files), assume_year=2025)[1])
    return named(events, names, EVENT), named(log_iocs(events), names, IOC), named(build_incidents(events), names, INCIDENT)


def results(spark, out):
    names = P.stored_logs(spark, out).select("log_id", F.substring_index("log", "/", -1).alias("log"))
    return (named(P.stored_events(spark, out), names, EVENT), named(P.stored_iocs(spark, out), names, IOC),
            named(P.stored_incidents(spark, out), names, INCIDENT))


def test_three_batches(spark, tmp_path, whole):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    parts = {n: cut(lines, (10, 55)) for n, lines in logs().items()}
    for k in range(3):  # every start is a restart from the checkpoint
        for name, pieces in parts.items():
            (landing / f"{name}.part{k + 9}").write_text("".join(x + "\n" for x in pieces[k]))  # 9, 10, 11
        P.stream_pieces(spark, str(landing), out, str(tmp_path / "checkpoint"), once=True, assume_year=2025).awaitTermination()
    waiting = [r.log.rsplit("/", 1)[-1] for r in P.stored_logs(spark, out).filter("log_type IS NULL").collect()]
    assert waiting == ["short.log"]
    P.flush_held(spark, out, 3, assume_year=2025)
    assert results(spark, out) == whole
    counts = {r.log.rsplit("/", 1)[-1]: r.line_count for r in P.stored_logs(spark, out).collect()}
    assert counts == {n: len(lines) for n, lines in logs().items()}


def landed(spark, folder):
    return spark.read.format("binaryFile").load(str(folder))


def test_repeated_batch(spark, tmp_path, whole):
    """A batch that fails after storing, and is done again, counts once; pieces of one batch keep their order."""
    out, folders = str(tmp_path / "out"), [tmp_path / "a", tmp_path / "b"]
    for folder in folders:
        folder.mkdir()
    for name, lines in logs().items():
        first, second, third = cut(lines, (5, 40))
        (folders[0] / f"{name}.part2").write_text("".join(x + "\n" for x in second))
        (folders[0] / f"{name}.part1").write_text("".join(x + "\n" for x in first))
        (folders[1] / f"{name}.part10").write_text("\n".join(third))  # the last line is not ended
    # the folder differs, so the log's name is that of the file
    files = [landed(spark, f).withColumn("path", F.substring_index("path", "/", -1)) for f in folders]
    P.write_pieces(files[0], 0, out, assume_year=2025)
    P.write_pieces(files[0], 0, out, assume_year=2025)
    P.write_pieces(files[1], 1, out, last=True, assume_year=2025)
    P.write_pieces(files[1], 1, out, last=True, assume_year=2025)
    assert results(spark, out) == whole


def test_large_pieces_are_listed(spark, tmp_path):
    out, folder = str(tmp_path / "out"), tmp_path / "a"
    folder.mkdir()
    (folder / "x.log.part1").write_text("a\n" * 100)
    (folder / "y.log.part1").write_text("b\n")
    P.write_pieces(landed(spark, folder), 0, out, max_bytes=50)
    rows = spark.read.parquet(f"{out}/rejected_pieces").collect()
    assert [r.path.rsplit("/", 1)[-1] for r in rows] == ["x.log.part1"] and rows[0].reason == "too_large"


def test_parts_add_up(spark):
    """Incident parts of any split of the events make the incidents of all."""
    rows = [(i % 2, "Privilege Escalation", "linux_syslog", i, None if i % 3 else "1.2.3.4", f"h{i % 7}" if i % 5 else None, "x")
            for i in range(60)]
    events = classify_events(spark.createDataFrame(
        rows, "log_id long, event_type string, log_type string, line_number int, source_ip string, hostname string, raw_line string"))
    key = lambda df: sorted(map(str, df.collect()))
    for most in (1000, 2):
        split = [incident_parts(events.filter(F.col("line_number") % 3 == k), max_hosts=most) for k in range(3)]
        merged = merge_parts(split[0].unionByName(split[1]).unionByName(split[2]), most)
        assert key(incidents_of(merged)) == key(build_incidents(events, max_hosts=most))
