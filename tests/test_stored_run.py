"""Claims before a run, failing runs, and runs at once."""

import pytest
from pyspark.sql import functions as F

from logwarden.plans import stored_run as R

LINE = "Jul  1 10:23:11 host sshd[1]: Failed password for root from 185.24.18.15 port 52431 ssh2"
LOGS = ("log_id long, status string, log_type string, processing_started_at timestamp, processing_completed_at timestamp, "
        "parsed_event_count long, ioc_count long, line_count long, parse_error string")


def at(second):
    return F.timestamp_seconds(F.lit(second))


@pytest.fixture(scope="module")
def given(spark):
    logs = spark.createDataFrame([(i, s, *[None] * 7) for i, s in enumerate(("pending", "pending", "failed", "completed"))], LOGS)
    lines = spark.createDataFrame([(i, n, LINE if n % 5 else "??") for i in range(4) for n in range(1, 41)],
                                  "log_id long, line_number int, raw_line string")
    return logs, lines


def status(run):
    return {r.log_id: r.status for r in run.logs.collect()}


def test_failing_run(spark, given, tmp_path):
    logs, lines = given
    out = str(tmp_path / "out")
    broken = lines.withColumn("raw_line", F.when(F.col("log_id") == 1, F.raise_error(F.lit("no such line"))).otherwise(F.col("raw_line")))
    run = R.run_and_store(logs, broken, out, "a", at(10), at(20), assume_year=2025)
    assert run.events is None and status(run) == {0: "failed", 1: "failed", 2: "failed", 3: "completed"}
    assert "no such line" in run.logs.filter("log_id = 0").first().parse_error
    # the stored changes alone tell the next run what it may take
    again = R.run_and_store(logs, lines, out, "b", at(30), at(40), assume_year=2025)
    assert status(again) == dict.fromkeys(range(4), "completed")
    rows = {r.log_id: (r.parsed_event_count, r.line_count) for r in again.logs.filter("log_id < 3").collect()}
    assert rows == dict.fromkeys(range(3), (32, 40))
    third = R.run_and_store(logs, lines, out, "c", at(50), at(60), assume_year=2025)
    assert third.events.count() == 0 and status(third) == status(again)
    assert spark.read.parquet(f"{out}/events").count() == 96


def test_programming_errors_are_raised(given, tmp_path):
    logs, lines = given
    with pytest.raises(TypeError):
        R.run_and_store(logs, lines, str(tmp_path / "out"), "a", at(10), at(20), no_such_option=1)
    changes = R.stored_changes(logs.sparkSession, str(tmp_path / "out")).filter("step = 'ended'").collect()
    assert {r.status for r in changes} == {"failed"}


def test_claims(spark, given, tmp_path):
    logs, lines = given
    out = str(tmp_path / "out")
    assert sorted(r.log_id for r in R.claim(logs, out, "a", at(10)).collect()) == [0, 1, 2]
    assert R.claim(logs, out, "b", at(11)).count() == 0  # claimed already
    other = R.run_and_store(logs, lines, out, "b", at(11), at(12), assume_year=2025)
    assert other.events.count() == 0 and status(other) == {0: "processing", 1: "processing", 2: "processing", 3: "completed"}
    crashed = R.run_and_store(logs, lines, out, "a", at(10), at(20), assume_year=2025)  # repeated, it takes its own again
    assert status(crashed) == dict.fromkeys(range(4), "completed")


def test_claims_at_once(spark, given, tmp_path, monkeypatch):
    """Two runs see the same free logs; the earlier one has them, the other takes its claim back."""
    logs, _ = given
    out = str(tmp_path / "out")
    real = R.write_changes

    def race(changes, where, run, step):
        real(changes, where, run, step)
        if run == "late" and not raced:
            raced.append(1)
            real(R.changes_of(logs.filter("log_id < 2"), "processing", at(5)), where, "early", "begun")

    raced = []
    monkeypatch.setattr(R, "write_changes", race)
    assert [r.log_id for r in R.claim(logs, out, "late", at(9)).collect()] == [2]
    begun = R.stored_changes(spark, out).filter("step = 'begun'").collect()
    assert sorted((r.run, r.log_id) for r in begun) == [("early", 0), ("early", 1), ("late", 2)]
