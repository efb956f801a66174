import pytest
from pyspark.sql import functions as F

from logwarden.operators import detect as D
from logwarden.sources import documents as Docs
from logwarden.sources import logs as Logs
from logwarden.sources import tables as Tables


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_log_files(spark, tmp_path):
    write(tmp_path, "a.log", b"\xef\xbb\xbfone\r\n\n  \ntwo\x0bthree\n" + b"x" * 40_000)
    write(tmp_path, "b.log", b"caf\xe9\n")
    write(tmp_path, "c.log", b" \n")
    files = Logs.read_log_files(spark, str(tmp_path))
    lines = Logs.log_lines(files).join(files.select("log_id", "filename"), "log_id")
    got = {n: [(r.line_number, r.raw_line) for r in sorted(lines.filter(F.col("filename") == n).collect(), key=lambda r: r.line_number)] for n in ("a.log", "b.log", "c.log")}
    assert got["a.log"][:3] == [(1, "one"), (4, "two"), (5, "three")]
    assert got["a.log"][3][0] == 6 and len(got["a.log"][3][1]) == 40_000
    assert got["b.log"] == [(1, "café")] and got["c.log"] == []
    stats = {r.filename: r for r in Logs.log_file_stats(files).join(files.select("log_id", "filename"), "log_id").collect()}
    assert (stats["a.log"].line_count, stats["c.log"].rejected, stats["b.log"].rejected) == (5, "empty", None)
    assert stats["b.log"].file_size_bytes == 6
    assert Logs.read_log_files(spark, str(tmp_path), max_bytes=100).count() == 2


def test_big_files_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 20_001))
    write(tmp_path, "big.log", text.encode())
    write(tmp_path, "latin.log", ("ok é\n" * 3).encode() + b"caf\xe9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = Logs.read_big_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        rows = [(r.line_number, r.raw_line) for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r for r in rows if r[1].startswith("line")) == [(i, f"line {i}") for i in range(1, 20_001) if i % 7]
    assert (4, "café") in rows and (1, "ok Ã©") in rows


def test_detection(spark, lines):
    ssh = "Jul  1 10:23:11 server sshd[1234]: Failed password for root from 185.24.18.15 port 52431 ssh2"
    assert D.detect_log_type(lines("x", "", ssh)).first().log_type == "linux_syslog"
    junk = D.detect_log_type(lines("x", "hello world")).first()
    assert (junk.log_type, junk.confidence) == ("unknown", 0.0)
    # Windows XML alone stays below the threshold, its confidence is kept
    xml = D.detect_log_type(lines("x", "<Event xmlns='a'><EventID>1000</EventID><Channel>x</Channel><Provider Name='y'/>")).first()
    assert xml.log_type == "unknown" and abs(xml.confidence - 9.5 / 24.5) < 1e-9
    # a pattern beyond the first 30 non-blank lines does not count
    late = D.detect_log_type(lines("x", *["filler"] * 30, ssh)).first()
    assert late.log_type == "unknown"
    logs = spark.createDataFrame([(1, "sysmon"), (2, None), (3, "unknown")], "log_id long, force_log_type string")
    got = {r.log_id: (r.log_type, r.confidence) for r in D.detect_with_override(logs, D.detect_log_type(lines("x", ssh))).collect()}
    assert got == {1: ("sysmon", 1.0), 2: ("unknown", 0.0), 3: ("unknown", 0.0)}


def test_text_and_json_documents(spark, tmp_path):
    write(tmp_path, "playbooks/T1059.001-x.md", b"  Body about CVE-2021-44228  ")
    write(tmp_path, "plain/empty.txt", b"  \n")
    write(tmp_path, "plain/skip.pdf", b"x")
    docs = Docs.read_text_docs(spark, str(tmp_path)).collect()
    assert len(docs) == 1
    assert (docs[0].content, docs[0].source_type, docs[0].technique_id, docs[0].cve_id) == (
        "Body about CVE-2021-44228", "playbook", "T1059.001", "CVE-2021-44228")
    write(tmp_path, "nvd/a.json", b'[{"id": "CVE-2020-0001", "description": " d ", "severity": "Moderate", "n": 3, "deep": {"x": 1}}, 5, "{}"]')
    write(tmp_path, "nvd/b.jsonl", b'{"a": "x", "id": 7, "ok": true}\nnot json\n\n{"text": "t", "url": "http://u", "techniqueId": "T1003"}\n')
    write(tmp_path, "nvd/c.json", b"{bad")
    files = Docs.read_files(spark, str(tmp_path / "nvd"))
    objects = Docs.json_objects(files)
    assert [r.path.split("/")[-1] for r in objects.filter("error is not null").collect()] == ["c.json"]
    got = {r.content: r for r in Docs.json_docs(objects).collect()}
    assert set(got) == {"d", '{\n  "a": "x",\n  "ok": true\n}', "t"}
    d = got["d"]
    assert (d.cve_id, d.severity, d.source_type, d.metadata["n"]) == ("CVE-2020-0001", "medium", "nvd", "3")
    assert "deep" not in d.metadata and "description" not in d.metadata
    t = got["t"]
    assert (t.source_url, t.technique_id, t.metadata["jsonl_line"]) == ("http://u", "T1003", "4")


def test_upsert_by_bucket(spark, tmp_path):
    path = str(tmp_path / "table")
    assert Tables.read_table(spark, path) is None
    newest = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new)
    rows = lambda *ids: spark.createDataFrame([(i, v) for i, v in ids], "id long, v int")
    Tables.upsert(rows(*[(i, 1) for i in range(50)]), path, "id", newest, 8)
    Tables.upsert(rows((3, 2), (60, 2)), path, "id", newest, 8)
    got = {r.id: r.v for r in Tables.read_table(spark, path).collect()}
    assert got == {**{i: 1 for i in range(50)}, 3: 2, 60: 2}
    with pytest.raises(Exception):
        Tables.read_table(spark, "nowhere://x")


def test_line_numbers_beyond_the_limit_of_whole_files(spark, monkeypatch):
    """More text of a language than one whole file may have lands in more files, which both readers read."""
    from logwarden.plans import catalog
    from logwarden.sources import logs

    sf = "/root/testdata/sf0.001"
    usual = catalog.q_line_numbers(spark, sf).collect()
    monkeypatch.setattr(logs, "MAX_FILE_BYTES", 100_000)
    read = logs.read_log_files
    monkeypatch.setattr(logs, "read_log_files", lambda spark, path: read(spark, path, max_bytes=100_000))
    assert catalog.q_line_numbers(spark, sf).collect() == usual and usual[0].different == 0


def test_batch_lines_are_dealt_over_tasks(spark):
    """A batch whose files come in one split keeps all cores busy, with the same numbered lines."""
    from logwarden.streaming.log_stream import batch_lines

    files = spark.createDataFrame(
        [(f"/in/{k}", 40, "".join(f"line {i}\n" for i in range(100)).encode()) for k in range(20)],
        "path string, length long, content binary").coalesce(1)
    lines = batch_lines(files)
    assert lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert batch_lines(files, bytes_a_task=10).rdd.getNumPartitions() == 80
    rows = [(r.line_number, r.raw_line) for r in lines.collect()]
    assert len(rows) == 2000 and set(rows) == {(i + 1, f"line {i}") for i in range(100)}


def test_json_ids_of_any_length(spark):
    ids = ["CVE-2024-1234", "CVE-2024-1234567", "cve-2024-10010000", "CVE-2024-6000010000", "CVE-2024-123", "CVE-2024-12345678x", "x CVE-2024-1234"]
    rows = [("/nvd/feed.jsonl", None, '{"description": "d%d", "id": "%s"}' % (i, v)) for i, v in enumerate(ids)]
    got = Docs.json_docs(spark.createDataFrame(rows, "path string, jsonl_line int, object string")).select("content", "cve_id").collect()
    assert {r.content: r.cve_id for r in got} == {
        "d0": "CVE-2024-1234", "d1": "CVE-2024-1234567", "d2": "CVE-2024-10010000", "d3": "CVE-2024-6000010000", "d4": None, "d5": None, "d6": None}


def test_detection_texts_spare_no_match():
    """A line that a signature matches holds one of its needed texts, so the cheap test ahead of it loses nothing."""
    import random
    import re

    random.seed(4)
    parts = ["<EventID>12</EventID>", "<EVENTID>77", "<Data  Name=\"processguid\"", "<DATA Name=\"SourceIp\"", "<data Name=\"RULENAME\"", "md5=" + "0a" * 16,
             "<Event xmlns='x'", "<CHANNEL>a</channel>",
             "<Provider Name=", "EventID = 4", "keywords:", "Log Name :", "Source name:", "Event Type:", "security ID:", "Account  Name:", "Logon Type :", "elfFILE",
             "sshd[1]:", "su:", " auth:", "AUTHPRIV:", "Invalid User", "Accepted Password", "sudo : x TTY=", "PAM_unix(", "kernel: [1.2]", '"GET /', 'HTTP/1.1" 200 5', "[WARN]",
             "ah00128:", '"-" "Mozilla/', "FastCGI", "connect() failed", "No live upstreams", "Recv() failed", "nginx/1.2.3", "Microsoft-WINDOWS-Sysmon", " ", "x"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 4))) for _ in range(20_000)]
    for patterns in D.SIGNATURES.values():
        for pattern, _ in patterns:
            needed, hits = D.needed_texts(pattern), [t for t in texts if re.search(pattern, t)]
            assert hits or not needed, pattern
            assert not needed or all(any(n in t.lower() for n in needed) for t in hits), pattern
    assert sum(len(p) for p in D.SIGNATURES.values()) < 64 and sum(not D.needed_texts(p) for ps in D.SIGNATURES.values() for p, _ in ps) == 5
