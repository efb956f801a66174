import datetime as dt

from pyspark.sql import functions as F

from logwarden.operators import updates as U
from logwarden.plans.log_run import run_logs
from logwarden.sources.tables import read_events, write_events
from logwarden.streaming.log_stream import stream_logs

SSH = "Jul  1 10:23:11 server sshd[1234]: Failed password for root from 185.24.18.15 port 52431 ssh2"
SUDO = "Jul  1 10:23:12 server sudo: bob : TTY=pts/0 ; PWD=/home/bob ; USER=root ; COMMAND=/bin/cat /etc/shadow"


def test_run_and_merge(spark, lines, tmp_path):
    run = run_logs(lines("x", SSH, "noise", SUDO, SSH).drop("log_type"), assume_year=2025)
    assert run.detected.first().log_type == "linux_syslog"
    assert run.events.count() == 3 and run.incidents.first().event_type == "Privilege Escalation"
    iocs = {(r.ioc_type, r.value): r for r in run.iocs.collect()}
    assert iocs[("ipv4", "185.24.18.15")].event_count == 2 and iocs[("ipv4", "185.24.18.15")].line_number == 1
    write_events(run.events, str(tmp_path / "e"))
    assert read_events(spark, str(tmp_path / "e")).filter("event_date = '2025-07-01'").count() == 3
    t1, t2 = (F.lit(dt.datetime(2025, 1, d)) for d in (1, 2))
    merged = U.merge_iocs(U.ioc_rows(run.iocs, t1), U.ioc_rows(run.iocs, t2)).collect()
    assert {r.occurrence_count for r in merged} == {2} and {(r.first_seen.day, r.last_seen.day) for r in merged} == {(1, 2)}


def test_max_events_and_override(spark, lines):
    forced = spark.createDataFrame([(1, "apache_access")], "log_id long, force_log_type string")
    assert run_logs(lines("x", SSH, SUDO).drop("log_type"), overrides=forced).events.count() == 0
    assert run_logs(lines("x", SSH, SUDO).drop("log_type"), max_events=1, assume_year=2025).events.count() == 1


def test_chunk_table(spark):
    old = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 1)], "node_id string, doc_hash string, v int")
    new = spark.createDataFrame([("b", "h2", 2), ("c", "h3", 2)], "node_id string, doc_hash string, v int")
    merged = U.merge_chunks(old, new)
    assert sorted((r.node_id, r.v) for r in merged.collect()) == [("a", 1), ("b", 2), ("c", 2)]
    rest, deleted = U.delete_by_doc_hash(merged, "h2")
    assert rest.count() == 2 and deleted.first().deleted == 1


def test_stream_counts_each_file_once(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    landing.mkdir()
    (landing / "a.log").write_text(SSH + "\n" + SUDO + "\n")
    stream_logs(spark, str(landing), out, checkpoint, once=True, assume_year=2025).awaitTermination()
    (landing / "b.log").write_text(SSH + "\n")
    stream_logs(spark, str(landing), out, checkpoint, once=True, assume_year=2025).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    assert events.count() == 3 and events.select("batch_id").distinct().count() == 2
    assert spark.read.parquet(f"{out}/incidents").count() == 1
    assert spark.read.parquet(f"{out}/iocs").filter("ioc_type = 'ipv4'").count() == 2


def test_line_width_is_a_parameter(spark):
    from logwarden.sources.tables import event_rows

    rows = spark.createDataFrame([("x" * 5000,)], "raw_line string").withColumn("event_timestamp", F.lit(None).cast("timestamp"))
    assert len(event_rows(rows).first().raw_line) == 5000 and len(event_rows(rows, 4096).first().raw_line) == 4096


def test_upsert_makes_new_rows_once(spark, tmp_path):
    from logwarden.sources.tables import read_table, upsert

    made = spark.sparkContext.accumulator(0)

    def count(i):
        made.add(1)
        return i

    def merge(old, new):
        return old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))

    path = str(tmp_path / "t")
    upsert(spark.range(5).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), path, "k", merge)
    new = spark.range(3, 8).select(F.udf(count, "long")("id").alias("k"), F.lit(2).cast("long").alias("v"))
    upsert(new, path, "k", merge)
    assert made.value == 5
    assert sorted((r.k, r.v) for r in read_table(spark, path).collect()) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 2), (6, 2), (7, 2)]
