"""Named queries over the given tables: one per job of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions import network as N
from logwarden.functions.arrays import l2_normalise, let
from logwarden.functions.text import url_decode_twice, word_count
from logwarden.operators import address_blocks as Blocks
from logwarden.operators import block_index as X
from logwarden.operators import classify as C
from logwarden.operators import detect as D
from logwarden.operators import iocs as I
from logwarden.operators import knowledge as K
from logwarden.operators import paging as P
from logwarden.operators import parse
from logwarden.operators import registered_domain as Domains
from logwarden.operators import reports as R
from logwarden.operators import search as S
from logwarden.operators import stored_hashes as Hashes
from logwarden.operators import updates as U
from logwarden.operators import value_index as Values
from logwarden.operators import vector_cells as V
from logwarden.operators.incidents import build_incidents
from logwarden.operators.rules import rules_df
from logwarden.plans import branch_lines as B
from logwarden.plans import event_lines as E
from logwarden.plans.ingest import ingest_documents, ingest_into
from logwarden.plans.log_run import limit_events, process_lines
from logwarden.plans.stored_run import run_and_store
from logwarden.session import scratch_path, ship_package, spread, write_and_read
from logwarden.sources import documents as Docs
from logwarden.sources import logs as Logs
from logwarden.sources import tables as Tables
from logwarden.streaming import piece_stream as Pieces
from logwarden.streaming.log_stream import stream_logs

YEAR = 2024
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def events_of(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return spread(spark.read.parquet(f"{sf}/events.parquet"), always=True)


def micros(name: str) -> Column:
    """A timestamp as a number, which compares the same everywhere."""
    return F.unix_micros(name).alias(name)


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


# -- lines and events ---------------------------------------------------------

def syslog_events(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_syslog(E.lines_of(events_of(spark, sf), E.SYSLOG), YEAR)


def classified_syslog(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_events(syslog_events(spark, sf))


def syslog_with_iocs(spark: SparkSession, sf: str) -> DataFrame:
    return I.add_event_iocs(syslog_events(spark, sf))


def windows_events(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_windows(E.lines_of(events_of(spark, sf), E.WINDOWS))


def dispatched(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_logs(E.all_lines(events_of(spark, sf)), YEAR)


def classified_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_events(dispatched(spark, sf))


def syslog_ioc_table(spark: SparkSession, sf: str) -> DataFrame:
    return U.ioc_rows(I.log_iocs(syslog_with_iocs(spark, sf)), F.timestamp_seconds(F.lit(1_704_067_200)))


def windows_ioc_table(spark: SparkSession, sf: str) -> DataFrame:
    found = I.log_iocs(I.add_event_iocs(windows_events(spark, sf)))
    return U.ioc_rows(found, F.timestamp_seconds(F.lit(1_704_153_600)))


def classified_with_iocs(spark: SparkSession, sf: str) -> DataFrame:
    both = syslog_events(spark, sf).unionByName(windows_events(spark, sf).withColumn(
        "log_id", F.col("log_id") + 1_000_000_000))
    return I.add_event_iocs(C.classify_events(both))


def stored_run(spark: SparkSession, sf: str) -> DataFrame:
    """Classified events with their indicators, parsed and written once; reports read the columns they need."""
    return write_and_read(classified_with_iocs(spark, sf), "run")


def syslog_part(run: DataFrame) -> DataFrame:
    return run.filter(F.col("log_id") < 1_000_000_000)


def incidents_of(spark: SparkSession, sf: str) -> DataFrame:
    return build_incidents(classified_with_iocs(spark, sf))


# -- knowledge tables -----------------------------------------------------------

def documents_as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files in folders named by language, one file each."""
    docs = table(spark, sf, "documents")
    folder = (F.when(F.col("lang") == "de", "playbooks").when(F.col("lang") == "fr", "NVD")
              .when(F.col("lang") == "es", "rules").otherwise(F.col("source")))
    name = F.concat(F.lit("T"), F.lpad((F.col("doc_id") % 10_000).cast("string"), 4, "0"),
                    F.when(F.col("lang") == "es", ".pdf").otherwise(".md"))
    return docs.select("doc_id", F.concat_ws("/", F.lit("/kb"), folder, F.col("source"), name).alias("path"),
                       F.col("text").alias("content"))


def documents_as_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("content"), F.concat(F.lit("/kb/"), "doc_id").alias("source_path"),
        F.col("source").alias("source_type"), F.lit(None).cast("string").alias("source_url"),
        Docs.doc_hash(F.col("text")).alias("doc_hash"), F.lit(None).cast("string").alias("technique_id"),
        F.lit(None).cast("string").alias("cve_id"), F.lit(None).cast("string").alias("severity"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval nodes: documents and vectors that share an id."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("node_id"), "text", F.col("source").alias("source_type"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return docs.join(vectors, "node_id", "full_outer")


_stored: dict[tuple, object] = {}


def once_stored(spark: SparkSession, sf: str, name: str, build: Callable[[str], object]) -> object:
    """What ``build`` writes to a path of the shared folder, once per application and data."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = build(scratch_path(spark, name))
    return _stored[key]


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25_index(spark: SparkSession, sf: str) -> S.Bm25Index:
    """The index of the documents, built at the first search and stored for the next."""
    return once_stored(spark, sf, "bm25", lambda path: S.store_index(S.build_bm25(document_nodes(spark, sf)), spark, path))


def block_index(spark: SparkSession, sf: str) -> X.BlockIndex:
    return once_stored(spark, sf, "blocks", lambda path: X.write_blocks(bm25_index(spark, sf), path))


def cell_index(spark: SparkSession, sf: str) -> V.CellIndex:
    return once_stored(spark, sf, "cells", lambda path: V.write_cells(vectors_of(spark, sf), path))


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label: few rows, whatever the size of the table."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("vector")).select(
        F.col("label").cast("long").alias("query_id"), "vector")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def document_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 20 = 0").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def hybrid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text, with the centroid of one of the ten labels as vector."""
    vectors = centroids(spark, sf).select(F.col("query_id").alias("label"), "vector")
    return (text_queries(spark, sf).withColumn("label", F.col("query_id") % 10)
            .join(vectors, "label").select("query_id", "query", "vector"))


# -- queries --------------------------------------------------------------------

def q_read_log_lines(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("content"))
    return Logs.log_lines(files)


def q_log_file_stats(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("content"))
    return Logs.log_file_stats(files).withColumn("rejected", F.coalesce("rejected", F.lit("")))


def landed(spark: SparkSession, sf: str, unit: str, file_bytes: int | None = None) -> str:
    """The documents' texts as files of the lines of one source each, or of one language each; of about ``file_bytes`` bytes
    at most if given, then dealt over more files."""
    path = scratch_path(spark, "landing")
    docs = table(spark, sf, "documents").filter("text <> ''")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] if file_bytes else 0
    part = F.pmod(F.xxhash64("doc_id"), F.lit(-(-size // file_bytes) if size else 1)).cast("int").alias("part")
    docs.select(unit, part, F.regexp_replace("text", "\n", "\x0b").alias("value")) \
        .repartition(unit, "part").write.partitionBy(unit, "part").text(path)
    return path


def q_read_big_log_lines(spark, sf):
    """Every line text of files read in splits, with how often it occurs; a vertical tab breaks lines too."""
    lines = Logs.read_big_log_lines(spark, landed(spark, sf, "source"))
    return lines.groupBy(F.md5("raw_line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def q_line_numbers(spark, sf):
    """Both readers number lines alike: lines and numbers per file, and how many of them differ. The files stay well below
    the limit of whole-file reading, beyond which the reader of whole files lists a file as rejected."""
    path = landed(spark, sf, "lang", Logs.MAX_FILE_BYTES // 4)
    big = Logs.read_big_log_lines(spark, path).select("log_id", "line_number", F.col("raw_line").alias("big"))
    small = Logs.log_lines(Logs.read_log_files(spark, path)).withColumnRenamed("raw_line", "small")
    both = big.join(small, ["log_id", "line_number"], "full_outer")
    return both.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("big").eqNullSafe(F.col("small"))).alias("different"))


def q_rejected_files(spark, sf):
    """Files over a limit: listed with their reason, and still read line by line."""
    path, limit = landed(spark, sf, "source"), 1 << 13
    rejected = Logs.rejected_files(spark, path, max_bytes=limit).agg(F.count(F.lit(1)))
    whole = Logs.read_log_files(spark, path, max_bytes=limit).agg(F.count(F.lit(1)))
    lines = Logs.read_log_lines(spark, path, max_bytes=limit).agg(
        F.count_distinct("log_id").alias("files_with_lines"), F.count(F.lit(1)).alias("lines"))
    return lines.select((rejected.scalar() + whole.scalar()).alias("files"), (rejected.scalar() > 0).alias("some_rejected"),
                        "files_with_lines", "lines")


def q_write_events(spark, sf):
    path = scratch_path(spark, "events")
    Tables.write_events(classified_syslog(spark, sf), path)
    stored = Tables.read_events(spark, path)
    return stored.groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("raw_line")).cast("long").alias("longest"))


def q_upsert_iocs(spark, sf):
    merged = U.merge_iocs(syslog_ioc_table(spark, sf), windows_ioc_table(spark, sf))
    return merged.select("log_id", "ioc_type", "value", "occurrence_count", micros("first_seen"), micros("last_seen"))


def q_upsert_chunks(spark, sf):
    docs = table(spark, sf, "documents")
    existing = docs.select(F.concat(F.lit("d"), "doc_id").alias("node_id"), "text", F.lit(1).alias("version"))
    new = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("node_id"), F.lower("text").alias("text"), F.lit(2).alias("version"))
    return U.merge_chunks(existing, new).select("node_id", "version", F.md5("text").alias("text_md5"))


def q_delete_by_doc_hash(spark, sf):
    docs = documents_as_docs(spark, sf).withColumn("lang", F.col("metadata")["lang"])
    doomed = docs.filter(F.col("lang") == "es").select("doc_hash")
    remaining, _ = U.delete_by_doc_hashes(docs, doomed)
    return remaining.select("doc_id", "doc_hash")


def q_deleted_counts(spark, sf):
    docs = documents_as_docs(spark, sf).withColumn("lang", F.col("metadata")["lang"])
    doomed = docs.filter(F.col("lang") == "es").select("doc_hash")
    return U.delete_by_doc_hashes(docs, doomed)[1]


def q_text_docs(spark, sf):
    docs = Docs.text_docs(documents_as_files(spark, sf).drop("doc_id"))
    return docs.select("source_path", "source_type", "doc_hash", F.coalesce("technique_id", F.lit("")).alias("technique_id"),
                       F.col("metadata")["file_extension"].alias("file_extension"), F.length("content").cast("long").alias("chars"))


def q_json_docs(spark, sf):
    """Documents written as JSON lines and loaded again."""
    path = scratch_path(spark, "nvd")
    docs = table(spark, sf, "documents")
    (docs.select(F.col("text").alias("description"), F.concat(F.lit("CVE-2024-"), F.col("doc_id") + 10_000).alias("id"),
                 F.when(F.col("lang") == "de", "Moderate").otherwise("HIGH").alias("baseSeverity"),
                 F.concat(F.lit("http://kb/"), "source").alias("link"), "lang", "n_chars")
     .write.json(path))
    lines = spark.read.text(path).select(F.lit("/nvd/feed.jsonl").alias("path"), F.lit(None).cast("int").alias("jsonl_line"),
                                         F.col("value").alias("object"))
    loaded = Docs.json_docs(lines)
    return loaded.select("doc_hash", "source_type", "source_url", "cve_id", "severity",
                         F.col("metadata")["lang"].alias("lang"), F.col("metadata")["n_chars"].alias("n_chars"))


def q_scroll_chunks(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("source_type"), "lang")
    return P.scroll_chunks(chunks, {"source_type": "src3", "lang": ""}, 100, 50)


def q_recent_activity(spark, sf):
    audit = events_of(spark, sf).select(F.col("event_id").alias("audit_id"), "user_id",
                                        F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return P.recent_activity(audit).select("user_id", "audit_id", "action", "rank")


def detection_lines(spark, sf):
    return E.all_lines(events_of(spark, sf)).drop("log_type")


def q_sample_lines(spark, sf):
    return D.sample_lines(detection_lines(spark, sf))


def q_score_formats(spark, sf):
    scores = D.score_formats(D.sample_lines(detection_lines(spark, sf)))
    return scores.select("log_id", *[F.round(f"score_{t}", 6).alias(f"score_{t}") for t in D.SIGNATURES])


def q_detect_formats(spark, sf):
    return D.detect_log_type(detection_lines(spark, sf)).select("log_id", "log_type", F.round("confidence", 6).alias("confidence"))


def _overrides(spark, sf):
    """Nginx logs look like Apache, so their owners force the type; the others force 'unknown'."""
    users = events_of(spark, sf).select("user_id").distinct()
    every = users.select(F.explode(F.sequence(F.col("user_id") * 5, F.col("user_id") * 5 + 4)).alias("log_id"))
    return every.withColumn("force_log_type", F.when(F.col("log_id") % 5 == 2, "nginx_access").otherwise("unknown"))


def q_detect_with_override(spark, sf):
    detected = D.detect_log_type(detection_lines(spark, sf))
    return D.detect_with_override(_overrides(spark, sf), detected).withColumn("confidence", F.round("confidence", 6))


_EVENT_COLUMNS = ("log_id", "line_number", "event_type", "username", "source_ip")


def q_syslog_parse(spark, sf):
    return syslog_events(spark, sf).select(
        *_EVENT_COLUMNS, "source_port", "service", "hostname", "process_name", "process_id", "command_line",
        F.col("normalized_data")["working_dir"].alias("working_dir"), micros("event_timestamp"))


def q_apache_parse(spark, sf):
    return parse.parse_apache(E.lines_of(events_of(spark, sf), E.APACHE)).select(
        *_EVENT_COLUMNS, "dest_port", "protocol", "url", "http_method", "http_status_code", "user_agent",
        F.col("normalized_data")["bytes"].alias("bytes"), F.col("normalized_data")["attack_type"].alias("attack_type"),
        F.col("normalized_data")["decoded_path"].alias("decoded_path"), micros("event_timestamp"))


def q_apache_error_parse(spark, sf):
    return parse.parse_apache(E.lines_of(events_of(spark, sf), E.APACHE_ERROR)).select(
        *_EVENT_COLUMNS, "process_id", "service", F.col("normalized_data")["message"].alias("message"),
        F.col("normalized_data")["is_error"].alias("is_error"), micros("event_timestamp"))


def q_nginx_parse(spark, sf):
    return parse.parse_nginx(E.lines_of(events_of(spark, sf), E.APACHE)).select(
        *_EVENT_COLUMNS, "url", "http_status_code", "user_agent",
        F.col("normalized_data")["referer"].alias("referer"), micros("event_timestamp"))


def q_nginx_error_parse(spark, sf):
    return parse.parse_nginx(E.lines_of(events_of(spark, sf), E.NGINX_ERROR)).select(
        *_EVENT_COLUMNS, "http_method", "url", "hostname", "process_id",
        F.col("normalized_data")["upstream"].alias("upstream"), micros("event_timestamp"))


def q_sysmon_parse(spark, sf):
    return parse.parse_sysmon(E.lines_of(events_of(spark, sf), E.SYSMON)).select(
        *_EVENT_COLUMNS, "dest_ip", "source_port", "dest_port", "protocol", "hostname", "process_name", "process_id",
        "command_line", "file_path", "url", F.col("normalized_data")["event_id"].alias("event_id"),
        F.col("normalized_data")["hashes"].alias("hashes"), F.size("data_fields").cast("long").alias("n_fields"),
        micros("event_timestamp"))


def q_windows_parse(spark, sf):
    return windows_events(spark, sf).select(
        *_EVENT_COLUMNS, "source_port", F.col("normalized_data")["event_id"].alias("event_id"), micros("event_timestamp"))


def q_windows_xml_parse(spark, sf):
    return parse.parse_windows(E.lines_of(events_of(spark, sf), E.WINDOWS_XML)).select(
        *_EVENT_COLUMNS, "source_port", "hostname", F.col("normalized_data")["event_id"].alias("event_id"),
        micros("event_timestamp"))


def q_parse_dispatch(spark, sf):
    return dispatched(spark, sf).select("log_id", "line_number", "log_type", "event_type", "source_ip", "username")


def branch_events(spark: SparkSession, sf: str, log_type: str) -> DataFrame:
    """Every outcome of a parser, by templates over the events."""
    return parse.parse_logs(B.branch_lines(events_of(spark, sf), log_type), YEAR).select(
        "log_id", "line_number", "event_type", F.coalesce("process_name", F.lit("")).alias("process_name"),
        F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("process_id", F.lit(-1)).alias("process_id"))


def q_syslog_branches(spark, sf):
    return branch_events(spark, sf, "linux_syslog")


def q_apache_branches(spark, sf):
    return branch_events(spark, sf, "apache_access").select("log_id", "line_number", "event_type")


def q_nginx_branches(spark, sf):
    return branch_events(spark, sf, "nginx_access").select("log_id", "line_number", "event_type")


def q_sysmon_branches(spark, sf):
    return branch_events(spark, sf, "sysmon").drop("process_id")


def q_windows_branches(spark, sf):
    return branch_events(spark, sf, "windows_event").select("log_id", "line_number", "event_type", "process_name", "process_id")


def q_url_decode(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", url_decode_twice(F.concat(F.replace("url", F.lit("/"), F.lit("%252F")), F.lit("+%zz"))).alias("decoded"))


def q_refang(spark, sf):
    pages = table(spark, sf, "pages")
    fanged = F.replace(F.replace("url", F.lit("."), F.lit("[.]")), F.lit("http"), F.lit("hxxp"))
    return pages.select("page_id", I.refang(fanged).alias("url"))


def _values(df: DataFrame, key: str, found: Column) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(found)).alias("value"))


def _typed(df: DataFrame, text: str, key: str, *types: str) -> DataFrame:
    return I.text_iocs(df, text, key, types=types).select(key, "ioc_type", "value")


def q_ioc_email(spark, sf):
    return _typed(table(spark, sf, "documents"), "text", "doc_id", "email")


def q_ioc_ipv4(spark, sf):
    return _typed(table(spark, sf, "documents"), "text", "doc_id", "ipv4")


def q_ioc_hash(spark, sf):
    return _typed(table(spark, sf, "documents"), "text", "doc_id", "md5", "sha1", "sha256")


def q_ioc_url(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return _typed(pages, "text", "page_id", "url")


def q_ioc_domain(spark, sf):
    """Domains of url and page text."""
    pages = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return _typed(pages, "text", "page_id", "domain").select("page_id", "value")


def q_ioc_ipv6(spark, sf):
    text = F.expr(E.spark_text(E.THREAT_NOTE))
    return _values(events_of(spark, sf), "event_id", F.transform(I.ipv6_values(text), N.canonical_ipv6))


def threat_notes(spark, sf):
    return events_of(spark, sf).select("event_id", F.expr(E.spark_text(E.THREAT_NOTE)).alias("note"))


def q_text_iocs(spark, sf):
    return I.text_iocs(threat_notes(spark, sf), "note", "event_id").select(
        "event_id", F.col("position").cast("long").alias("position"), "ioc_type", "value", F.round("confidence", 3).alias("confidence"))


def q_text_ioc_context(spark, sf):
    found = I.text_iocs(threat_notes(spark, sf), "note", "event_id", types=("cve",))
    return found.select("event_id", "value", "context")


def q_event_iocs(spark, sf):
    return I.explode_iocs(syslog_with_iocs(spark, sf)).select(
        "log_id", "line_number", F.col("position").cast("long").alias("position"), "ioc_type", "value",
        F.round("confidence", 3).alias("confidence"), "source_field")


def q_ioc_dedup(spark, sf):
    return I.log_iocs(syslog_with_iocs(spark, sf)).select(
        "log_id", "ioc_type", "value", "line_number", "source_field", "event_count")


def q_rules(spark, sf):
    """The rules, with the number of events of all formats they match."""
    matched = C.match_rules(dispatched(spark, sf)).select(F.explode(F.array_compact("_matched")).alias("r"))
    hits = matched.groupBy(F.col("r.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("events"))
    return rules_df(spark).join(hits, "rule_id", "left").select(
        "rule_id", "severity_score", "technique_id", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def q_classify(spark, sf):
    return classified_all(spark, sf).select(
        "log_id", "line_number", "event_type", "severity", "severity_score", "mitre_technique_id", "mitre_tactic",
        "sub_technique_id", "threat_category", F.round("confidence", 2).alias("confidence"),
        joined("matched_rules"), joined("tags"), "is_classified")


def word_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every word of five letters or more of the benchmark texts."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})")))).alias("w")
    words = table(spark, sf, "benchmark").select(word).distinct()
    n, none = F.length("w"), F.lit(None).cast("string")
    columns = {
        "rule_id": F.col("w"), "patterns": F.array("w"),
        "log_types": F.when(n % 3 == 0, F.array(F.concat(F.lit("src"), n))).otherwise(F.array().cast("array<string>")),
        **dict.fromkeys(("tactic_id", "tactic_name", "technique_id", "technique_name", "sub_technique_id", "sub_technique_name"), none),
        "severity_score": 1 + n % 10, "threat_category": F.substring("w", 1, 2), "tags": F.array(F.substring("w", 1, 1)),
        "priority": n, "seq": F.conv(F.substring(F.md5("w"), 1, 12), 16, 10).cast("long")}
    return words.select(*(c.alias(name) for name, c in columns.items()))


def q_classify_by_rule_table(spark, sf):
    """The documents' texts as event types, their sources as log types, against a rule for every word of the benchmark."""
    events = table(spark, sf, "documents").select("doc_id", F.col("text").alias("event_type"), F.col("source").alias("log_type"))
    return C.classify_events(events, word_rules(spark, sf)).select(
        "doc_id", F.size("matched_rules").alias("n_matched"), F.md5(F.array_join("matched_rules", "|")).alias("matched_md5"),
        "severity", "severity_score", "threat_category", F.size("tags").alias("n_tags"), "confidence")


def q_enrich_events(spark, sf):
    """The audit entries written into normalized_data, read back from JSON."""
    enriched = C.enrich_events(I.add_event_iocs(classified_syslog(spark, sf)))
    audit, summary = F.col("normalized_data")["classification"], F.col("normalized_data")["extracted_iocs"]
    return enriched.select(
        "log_id", "line_number", F.get_json_object(audit, "$.technique_id").alias("technique_id"),
        F.get_json_object(audit, "$.severity").alias("severity"),
        F.coalesce(F.json_array_length(summary), F.lit(0)).cast("long").alias("n_iocs"),
        F.get_json_object(summary, "$[0].value").alias("first_ioc"))


def q_log_run(spark, sf):
    """Detection, parsing, indicators and classification of raw lines in one go."""
    _, events = process_lines(detection_lines(spark, sf), overrides=_overrides(spark, sf), assume_year=YEAR)
    return events.groupBy("log_id", "log_type", "event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


def q_run_and_store(spark, sf):
    """Pending logs run and stored, every tenth line unreadable; then the run again, which finds nothing to do."""
    none, out = F.lit(None), scratch_path(spark, "store")
    logs = write_and_read(logs_table(spark, sf).select(
        "log_id", "status", *[none.cast(k).alias(n) for n, k in (
            ("log_type", "string"), ("processing_started_at", "timestamp"), ("processing_completed_at", "timestamp"),
            ("parsed_event_count", "long"), ("ioc_count", "long"), ("line_count", "long"), ("parse_error", "string"))]), "logs")
    lines = E.lines_of(events_of(spark, sf), E.SYSLOG).withColumn(
        "raw_line", F.when(F.col("line_number") % 10 == 0, "?? not a log line").otherwise(F.col("raw_line")))

    def run(table: DataFrame, name: str, hour: int):
        begin, end = F.timestamp_seconds(F.lit(hour * 3600)), F.timestamp_seconds(F.lit(hour * 3600 + 60))
        return run_and_store(table, lines, out, name, begin, end, assume_year=YEAR)

    first = run(logs, "a", 1)
    done = write_and_read(first.logs, "logs")
    again = run(done, "b", 2)
    events = spark.read.parquet(f"{out}/events").groupBy("log_id").agg(F.count(F.lit(1)).alias("events"))
    iocs = spark.read.parquet(f"{out}/iocs").groupBy("log_id").agg(F.count(F.lit(1)).alias("iocs"))
    rejected = spark.read.parquet(f"{out}/rejected_lines").groupBy("log_id").agg(F.count(F.lit(1)).alias("rejected"))
    zero = F.lit(0).cast("long")
    return again.logs.join(events, "log_id", "left").join(iocs, "log_id", "left").join(rejected, "log_id", "left").select(
        "log_id", "status", "log_type", micros("processing_started_at"), micros("processing_completed_at"), "parsed_event_count",
        "line_count", (F.col("ioc_count") == F.col("iocs")).alias("iocs_agree"),
        *[F.coalesce(c, zero).alias(c) for c in ("events", "rejected")])


def q_limit_events(spark, sf):
    return limit_events(syslog_events(spark, sf), 20).select("log_id", "line_number", "event_type")


def q_threat_events(spark, sf):
    return classified_all(spark, sf).filter(C.is_threat()).select("log_id", "line_number", "event_type", "severity_score")


def q_critical_events(spark, sf):
    return classified_all(spark, sf).filter(C.is_critical()).select("log_id", "line_number", "event_type", "severity")


def q_pipeline_stats(spark, sf):
    events = write_and_read(I.add_event_iocs(classified_syslog(spark, sf)), "run")
    lines = E.lines_of(events_of(spark, sf), E.SYSLOG).groupBy("log_id").agg(F.count(F.lit(1)).alias("total_lines"))
    stats = R.pipeline_stats(events, lines)
    kinds = [F.coalesce(F.try_element_at("ioc_type_counts", F.lit(t)), F.lit(0)).alias(f"iocs_{t}")
             for t in ("ipv4", "username", "domain", "port", "file_path")]
    return stats.select(*[c for c in stats.columns if c != "ioc_type_counts"], *kinds)


def q_run_summary(spark, sf):
    lines = E.lines_of(events_of(spark, sf), E.SYSLOG)
    events = write_and_read(I.add_event_iocs(classified_syslog(spark, sf)), "run")
    counts = lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_lines"))
    summary = R.run_summary(D.detect_log_type(lines), events, R.pipeline_stats(events, counts))

    def text(name: str, *fields: str) -> Column:
        return F.array_join(F.transform(name, lambda r: F.concat_ws("=", *[r[f] for f in fields])), "|").alias(name)

    return summary.select("log_id", "log_type", "detection_confidence", "parsed_events", "unique_iocs",
                          text("top_source_ips", "source_ip", "count"),
                          text("mitre_hits", "mitre_technique_id", "count"))


def q_severity_breakdown(spark, sf):
    return R.severity_breakdown(classified_all(spark, sf))


def q_severity_per_log(spark, sf):
    return R.severity_breakdown_per_log(classified_all(spark, sf))


def q_event_count(spark, sf):
    return R.row_count(dispatched(spark, sf), "total_events")


def q_ioc_count(spark, sf):
    return R.row_count(syslog_ioc_table(spark, sf), "total_iocs")


def q_incident_count(spark, sf):
    return R.row_count(incidents_of(spark, sf), "total_incidents")


def q_unique_ioc_values(spark, sf):
    return R.unique_ioc_values(syslog_ioc_table(spark, sf))


def q_ioc_type_summary(spark, sf):
    return R.ioc_type_summary(syslog_ioc_table(spark, sf))


def logs_table(spark: SparkSession, sf: str) -> DataFrame:
    """A log per user, in one of three states, sized by its events."""
    n = events_of(spark, sf).groupBy("user_id").agg(F.min("ts").alias("created_at"))
    state = F.element_at(F.array(F.lit("pending"), F.lit("processing"), F.lit("completed")), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in E.FORMATS]), (F.col("user_id") % 5 + 1).cast("int"))
    return n.select(F.col("user_id").alias("log_id"), state.alias("status"), kind.alias("log_type"),
                    (F.col("user_id") % 4).alias("uploaded_by"), F.col("created_at").cast("timestamp").alias("created_at"))


def q_log_status_counts(spark, sf):
    return R.group_counts(logs_table(spark, sf), "status")


def q_log_type_breakdown(spark, sf):
    return R.log_type_breakdown(logs_table(spark, sf))


def q_incident_status_counts(spark, sf):
    return R.group_counts(incidents_of(spark, sf), "status")


def q_incident_severity_counts(spark, sf):
    return R.group_counts(incidents_of(spark, sf), "severity")


def q_incidents(spark, sf):
    return incidents_of(spark, sf).select(
        "log_id", "title", "description", "severity", "status", "event_type", "event_count", "ioc_count",
        joined("mitre_techniques"), joined("mitre_tactics"), joined("source_ips"), joined("affected_hosts"))


def q_tactic_breakdown(spark, sf):
    return R.tactic_breakdown(classified_all(spark, sf))


def q_top_source_ips(spark, sf):
    return R.top_source_ips(dispatched(spark, sf))


def q_top_event_types(spark, sf):
    return R.top_event_types(dispatched(spark, sf))


def q_top_techniques(spark, sf):
    return R.top_mitre_techniques(classified_syslog(spark, sf))


def q_top_per_log(spark, sf):
    return R.top_per_log(dispatched(spark, sf), 3, "event_type")


def q_top_ioc_values(spark, sf):
    return R.top_ioc_values(syslog_ioc_table(spark, sf), "username")


def q_statistics(spark, sf):
    run = stored_run(spark, sf)
    events = syslog_part(run)
    iocs = write_and_read(U.ioc_rows(I.log_iocs(events), F.timestamp_seconds(F.lit(1_704_067_200))), "iocs")
    stats = R.statistics(logs_table(spark, sf), events, iocs, build_incidents(run))

    def text(name: str, *fields: str) -> Column:
        return F.array_join(F.transform(name, lambda r: F.concat_ws("=", *[r[f] for f in fields])), "|").alias(name)

    lists = {"ioc_type_summary": ("ioc_type", "count"), "top_source_ips": ("value", "total_occurrences"),
             "top_mitre_techniques": ("mitre_technique_id", "count"), "top_event_types": ("event_type", "count")}
    return stats.select(*[c for c in stats.columns if c not in lists], *[text(n, *f) for n, f in lists.items()])


def q_page_logs(spark, sf):
    return P.page_logs(logs_table(spark, sf), 2, 5, status="pending").select("log_id", "status", "log_type", micros("created_at"))


def q_page_counts(spark, sf):
    return P.page_counts(P.where(logs_table(spark, sf), status="pending"), 7)


def q_page_events(spark, sf):
    return P.page_events(classified_all(spark, sf), 3, 25, severity="high", event_type="").select(
        "log_id", "line_number", "event_type", "source_ip")


def q_page_threats(spark, sf):
    return P.page_threats(classified_all(spark, sf), 2, 50).select("log_id", "line_number", "severity_score")


def q_page_iocs(spark, sf):
    return P.page_iocs(syslog_ioc_table(spark, sf), 4, 30, ioc_type="ipv4").select("log_id", "ioc_type", "value")


def q_search_iocs(spark, sf):
    return P.search_iocs(syslog_ioc_table(spark, sf), "USER1", "username").select("log_id", "ioc_type", "value")


def q_search_iocs_indexed(spark, sf):
    """The same search by the trigram index of the stored values."""
    iocs = once_stored(spark, sf, "iocs", lambda path: stored(syslog_ioc_table(spark, sf), path))
    index = once_stored(spark, sf, "values", lambda path: Values.write_values(iocs, path))
    return Values.search_iocs_indexed(iocs, index, "USER1", "username").select("log_id", "ioc_type", "value")


def q_address_blocks(spark, sf):
    """Every event's address in the longest of the blocks that the events themselves give: /16, /24 and some /28."""
    rows = events_of(spark, sf).select("event_id", F.expr(E.IP).alias("source_ip"))
    three = F.substring_index("source_ip", ".", 3)
    blocks = rows.select(F.explode(F.array(
        F.lit("185.24.0.0/16"), F.when(F.col("event_id") % 3 == 0, F.concat(three, F.lit(".0/24"))),
        F.when(F.col("event_id") % 50 == 0, F.concat("source_ip", F.lit("/28"))))).alias("cidr")).filter("cidr IS NOT NULL").distinct()
    return Blocks.locate(rows, blocks).select("event_id", "source_ip", F.col("block.cidr").alias("cidr"))


def q_registered_domains(spark, sf):
    """The hosts of the pages by plain, wildcard and exception rules; the exceptions are sites of the pages."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")
    hosts = table(spark, sf, "pages").select(host).filter("host <> ''").distinct()
    site = F.substring_index("host", ".", -3)
    exceptions = hosts.filter("host LIKE '%.example.net' AND host LIKE '%tion%'").select(F.concat(F.lit("!"), site).alias("rule"))
    plain = spark.createDataFrame([(r,) for r in ("com", "net", "org", "example.com", "*.example.net", "// a comment", "")], "rule string")
    return Domains.registered_domains(hosts, plain.unionByName(exceptions))


def q_search_paths(spark, sf):
    """Windows paths, found by a text with backslashes."""
    paths = I.text_iocs(threat_notes(spark, sf), "note", "event_id", types=("file_path",))
    return P.search_iocs(paths, r"c:\users\USER1", "file_path").select("event_id", "value")


def q_long_xml_iocs(spark, sf):
    """Indicators behind thousands of characters of a Sysmon event."""
    text = F.concat(F.lit("<Event><System><Provider Name='Microsoft-Windows-Sysmon'/><EventID>5</EventID></System><EventData>"
                          "<Data Name='Description'>"), F.repeat(F.lit("x "), 20_000), F.lit("CVE-2024-"),
                    (F.col("event_id") % 90_000 + 10_000).cast("string"), F.lit("</Data></EventData></Event>"))
    lines = events_of(spark, sf).select(F.col("user_id").alias("log_id"), (F.col("event_id") + 1).cast("int").alias(
        "line_number"), text.alias("raw_line"))
    found = I.explode_iocs(I.add_event_iocs(parse.parse_sysmon(lines)))
    return found.filter(F.col("ioc_type") == "cve").select("log_id", "line_number", "value")


def q_ioc_cap(spark, sf):
    """Sixty indicators in a line: all of them, and the first fifty if a cap is asked for."""
    many = F.array_join(F.transform(F.sequence(F.lit(10_000), F.lit(10_059)), lambda i: F.concat(
        F.lit("CVE-2024-"), i.cast("string"))), " ")
    lines = E.lines_of(events_of(spark, sf), E.SYSLOG).withColumn("raw_line", F.concat("raw_line", F.lit(" "), many))
    events = I.add_event_iocs(parse.parse_syslog(lines, YEAR), contexts=False).select(
        "log_id", F.size(F.filter("iocs", lambda h: h["ioc_type"] == "cve")).alias("cves"),
        F.size(I.first_iocs(F.col("iocs"), 50)).alias("first_50"))
    return events.groupBy("log_id").agg(F.sum("cves").alias("cves_all"), F.sum("first_50").alias("iocs_50"))


def q_page_incidents(spark, sf):
    with_time = incidents_of(spark, sf).withColumn("created_at", F.timestamp_seconds(F.col("log_id")))
    return P.page_incidents(with_time, 2, 20, severity="high").select("log_id", "title", "severity")


def q_apply_log_status(spark, sf):
    none = F.lit(None)
    logs = logs_table(spark, sf).select(
        "log_id", "status", none.cast("string").alias("log_type"), none.cast("timestamp").alias("processing_started_at"),
        none.cast("timestamp").alias("processing_completed_at"), none.cast("long").alias("parsed_event_count"),
        none.cast("string").alias("parse_error"))
    state = (F.when(F.col("event_type") == "signup", "processing").when(F.col("event_type") == "purchase", "completed")
             .when(F.col("event_type") == "error", "failed").otherwise("other"))
    changes = events_of(spark, sf).select(
        F.col("user_id").alias("log_id"), state.alias("status"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.lit("linux_syslog").alias("log_type"), F.col("event_id").alias("parsed_event_count"),
        F.lit(0).cast("long").alias("ioc_count"), F.lit(0).cast("long").alias("line_count"),
        F.concat(F.lit("error "), "event_id").alias("error"))
    return U.apply_log_status(logs, changes).select(
        "log_id", "status", "log_type", micros("processing_started_at"), micros("processing_completed_at"),
        "parsed_event_count", "parse_error")


def q_apply_incident_updates(spark, sf):
    none = F.lit(None)
    incidents = logs_table(spark, sf).select(
        F.col("log_id").alias("incident_id"), F.lit("open").alias("status"), none.cast("long").alias("assigned_to"),
        none.cast("timestamp").alias("closed_at"))
    state = (F.when(F.col("event_type") == "signup", "investigating").when(F.col("event_type") == "purchase", "closed")
             .when(F.col("event_type") == "error", "resolved").when(F.col("event_type") == "view", "bogus"))
    updates = events_of(spark, sf).select(
        F.col("user_id").alias("incident_id"), state.alias("status"),
        F.when(F.col("event_type") == "click", F.col("event_id") % 9).alias("assigned_to"),
        F.col("ts").cast("timestamp").alias("updated_at"))
    return U.apply_incident_updates(incidents, updates).select("incident_id", "status", "assigned_to", micros("closed_at"))


def q_validate_docs(spark, sf):
    checked = K.validate_docs(documents_as_docs(spark, sf))
    return checked.select("doc_id", "is_valid", F.coalesce("reason", F.lit("")).alias("reason"), joined("warnings"))


def q_doc_hash_dedup(spark, sf):
    stored = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").filter(F.col("toxic") == 1).select(
        Docs.doc_hash(F.col("text")).alias("doc_hash"))
    return K.drop_duplicate_docs(documents_as_docs(spark, sf), stored, "doc_id").select("doc_id", "doc_hash")


def q_doc_hash_filter(spark, sf):
    """Documents stored by two ingestions, Spanish and German ones; then the new ones among all, by the persisted filter."""
    docs, out = documents_as_docs(spark, sf), scratch_path(spark, "hashes")
    for lang in ("es", "de"):
        Hashes.add_hashes(docs.filter(F.col("metadata")["lang"] == lang), out, lang)
    return K.drop_duplicate_docs(docs, Hashes.known_hashes(docs, out), "doc_id").select("doc_id", "doc_hash")


def some_without_hash(spark, sf):
    return documents_as_docs(spark, sf).withColumn("doc_hash", F.when(F.col("doc_id") % 3 > 0, F.col("doc_hash")))


def q_mark_duplicates(spark, sf):
    stored = table(spark, sf, "documents").filter("lang = 'es'").select(Docs.doc_hash(F.col("text")).alias("doc_hash"))
    return K.mark_duplicates(documents_as_docs(spark, sf), None, "doc_id").select("doc_id", "is_duplicate").join(
        K.mark_duplicates(some_without_hash(spark, sf), stored, "doc_id").select(
            "doc_id", F.col("is_duplicate").alias("is_known")), "doc_id")


def q_drop_duplicates_without_hash(spark, sf):
    return K.drop_duplicate_docs(some_without_hash(spark, sf), None, "doc_id").select("doc_id", "doc_hash")


def q_chunk_docs(spark, sf):
    return K.chunk_docs(documents_as_docs(spark, sf)).select(
        "doc_id", "chunk_index", "total_chunks", word_count(F.col("text")).alias("words"), "node_id")


def q_chunk_equal_sentences(spark, sf):
    """Texts of numbered ten-word sentences, 1 to 300 of them: where each chunk begins and how long it is."""
    sentences = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 300 + 1).cast("int")), lambda i: F.concat(
        F.lit("s"), i.cast("string"), F.lit(" b c d e f g h i j.")))
    docs = documents_as_docs(spark, sf).withColumn("content", F.array_join(sentences, " "))
    return K.chunk_docs(docs).select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"),
        word_count(F.col("text")).cast("long").alias("words"), F.regexp_extract("text", r"s(\d+) b", 1).cast("long").alias("first_sentence"))


def q_chunk_coverage(spark, sf):
    """Chunks per document in the cases a formula can tell: texts within one chunk, and size bounds."""
    chunks = K.chunk_docs(documents_as_docs(spark, sf)).withColumn("words", word_count(F.col("text")))
    return chunks.groupBy("doc_id").agg(
        (F.max("words") <= K.CHUNK_WORDS).alias("within_size"),
        (F.count(F.lit(1)) == F.max("total_chunks")).alias("all_numbered"),
        F.when(F.max("total_chunks") == 1, F.max("words").cast("long")).otherwise(-1).alias("single_chunk_words"))


def q_chunk_payload(spark, sf):
    whole = documents_as_docs(spark, sf).select(
        "doc_hash", F.concat(F.lit("n"), "doc_id").alias("node_id"), "source_path", "source_type", "source_url",
        "technique_id", "cve_id", "severity", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"),
        F.col("content").alias("text"), "metadata")
    return K.chunk_payload(whole).select(
        "node_id", "doc_hash", "source_type", "source_url", "technique_id",
        F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"))


def q_hashing_embed(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", "text")
    return K.hashing_embed(chunks, dim=256).select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm2"))


def q_l2_normalise(spark, sf):
    scaled = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return scaled.select("vec_id", F.posexplode(l2_normalise(F.col("v"))).alias("place", "x")).select(
        "vec_id", F.col("place").cast("long").alias("place"), F.round("x", 5).alias("x"))


def q_ingest_files(spark, sf):
    result = ingest_documents(documents_as_files(spark, sf).drop("doc_id"))
    return result.files.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def q_ingest_twice(spark, sf):
    """Half of the files ingested into a table, then all of them: its documents, whole and each once."""
    files, path = documents_as_files(spark, sf), scratch_path(spark, "kb")
    ingest_into(files.filter(F.col("doc_id") % 2 == 0).drop("doc_id"), path)
    ingest_into(files.drop("doc_id"), path)
    per_doc = Tables.read_table(spark, path).groupBy("doc_hash").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("node_id").alias("nodes"), F.max("total_chunks").alias("total"))
    return per_doc.select("doc_hash", ((F.col("chunks") == F.col("nodes")) & (F.col("chunks") == F.col("total"))).alias("whole"))


def q_upsert_iocs_stored(spark, sf):
    """The indicators of two runs upserted into a stored table."""
    path = scratch_path(spark, "iocs")
    for rows in (syslog_ioc_table(spark, sf), windows_ioc_table(spark, sf)):
        Tables.upsert(rows, path, "log_id", U.merge_iocs)
    return Tables.read_table(spark, path).select(
        "log_id", "ioc_type", "value", "occurrence_count", micros("first_seen"), micros("last_seen"))


def q_ingestion_report(spark, sf):
    checked = K.mark_duplicates(K.validate_docs(documents_as_docs(spark, sf)), None, "doc_id")
    files = checked.select(
        F.when(~F.col("is_valid"), "failed").when(F.col("is_duplicate"), "skipped_duplicate").otherwise("indexed").alias("status"),
        word_count(F.col("content")).alias("chunks_indexed"))
    return R.ingestion_report(files)


def document_nodes(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")


def q_tokenise(spark, sf):
    return S.tokenise(document_nodes(spark, sf)).select("node_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def q_bm25_postings(spark, sf):
    return S.build_bm25(document_nodes(spark, sf)).postings.select("term", "node_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def q_bm25_terms(spark, sf):
    return S.term_idf(S.build_bm25(document_nodes(spark, sf))).select(
        "term", "df", F.round(F.col("idf") * 1_000_000).cast("long").alias("idf_millionths"))


def q_bm25_stats(spark, sf):
    return S.build_bm25(document_nodes(spark, sf)).stats.select("n_nodes", F.round("avg_len", 6).alias("avg_len"))


def q_bm25_search(spark, sf):
    return S.bm25_search(bm25_index(spark, sf), text_queries(spark, sf))


def q_bm25_block_search(spark, sf):
    """The same texts asked of the index of blocks."""
    return X.block_search(block_index(spark, sf), text_queries(spark, sf))


def q_similar_documents(spark, sf):
    """Every document whose id is divisible by 20 asked against all documents."""
    return X.block_search(block_index(spark, sf), document_queries(spark, sf))


def q_similar_vectors(spark, sf):
    """Every vector whose id is divisible by 20 asked against all vectors, exactly: all cells are looked into."""
    index = cell_index(spark, sf)
    return V.search_cells(index, vector_queries(spark, sf), probes=len(index.centres))


def q_similar_vectors_by_cells(spark, sf):
    """The same from the nearest cells alone; tests measure the recall against the exact result."""
    return V.search_cells(cell_index(spark, sf), vector_queries(spark, sf))


def q_dense_search(spark, sf):
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
    return S.dense_search(chunks, centroids(spark, sf))


def q_dense_search_filtered(spark, sf):
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
    return S.dense_search(chunks, centroids(spark, sf), 5, {"label": 3}, threshold=0.0)


def q_rrf_fuse(spark, sf):
    nodes, asked = nodes_of(spark, sf), hybrid_queries(spark, sf)
    fused = S.rrf_fuse(S.dense_search(nodes, asked), S.bm25_search(bm25_index(spark, sf), asked))
    return fused.select("query_id", "node_id", "rrf_score", "rank")


def q_hybrid_search(spark, sf):
    found = S.hybrid_search(nodes_of(spark, sf), hybrid_queries(spark, sf), bm25_index(spark, sf))
    return found.select("query_id", "node_id", "rrf_score", "rank", "source_type")


def q_knowledge_stats(spark, sf):
    return S.knowledge_stats(nodes_of(spark, sf)).select("points", "corpus_size", F.col("vector_dim").cast("long").alias("vector_dim"))


def q_stream_logs(spark, sf):
    """Land syslog files, run the stream until it has caught up, count what it stored."""
    base = scratch_path(spark, "stream")
    E.lines_of(events_of(spark, sf), E.SYSLOG).select("raw_line").write.text(f"{base}/landing")
    stream_logs(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", once=True, assume_year=YEAR).awaitTermination()
    stored = spark.read.parquet(f"{base}/out/events")
    return stored.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


def q_stream_pieces(spark, sf):
    """Syslog files of forty logs that land in three pieces each, one batch after the other; what is stored per log."""
    base = scratch_path(spark, "pieces")
    lines = E.lines_of(events_of(spark, sf), E.SYSLOG).withColumn("lg", F.col("log_id") % 40)
    n = lines.count()
    for k in range(3):
        part = lines.filter(F.least(F.lit(2), F.expr(f"(line_number - 1) * 3 div {max(n, 1)}")) == k)
        part.withColumn("piece", F.lit(k)).repartition("lg").sortWithinPartitions("lg", "line_number") \
            .select("lg", "piece", "raw_line").write.mode("append").partitionBy("lg", "piece").text(f"{base}/landing")
        Pieces.stream_pieces(spark, f"{base}/landing", f"{base}/out", f"{base}/checkpoint", once=True,
                             piece=r"/piece=(\d+)/[^/]*$", assume_year=YEAR).awaitTermination()
    out = f"{base}/out"
    Pieces.flush_held(spark, out, 1_000_000, assume_year=YEAR)
    counts = {
        "events": (Pieces.stored_events(spark, out), {"events": F.count("*"), "last_line": F.max("line_number")}),
        "iocs": (Pieces.stored_iocs(spark, out), {"indicators": F.count("*"), "hits": F.sum("event_count")}),
        "incidents": (Pieces.stored_incidents(spark, out), {
            "incidents": F.count("*"), "incident_events": F.sum("event_count"), "incident_iocs": F.sum("ioc_count"),
            "hosts": F.sum(F.size("affected_hosts"))})}
    rows = Pieces.stored_logs(spark, out).select(
        "log_id", F.regexp_extract("log", r"lg=(\d+)$", 1).cast("long").alias("lg"), "log_type", "line_count")
    for table_, aggregates in counts.values():
        rows = rows.join(table_.groupBy("log_id").agg(*(c.alias(name) for name, c in aggregates.items())), "log_id", "left")
    return rows.drop("log_id")


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
