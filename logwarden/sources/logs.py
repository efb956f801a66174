"""Log files to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.functions.text import is_blank

MAX_FILE_BYTES = 100 * 1024 * 1024
# Everything that ends a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def decode(content: Column) -> Column:
    """Bytes as UTF-8 when valid, else Latin-1 (which never fails); a BOM is dropped."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def _files(spark: SparkSession, path: str | list[str], glob: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_log_files(spark: SparkSession, path: str | list[str], glob: str | None = None,
                   recursive: bool = True, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Whole files up to the size limit: log_id, filename, file_bytes, content (text).

    The limit is pushed to the file source, so larger files are not read here;
    `rejected_files` lists them, and `read_log_lines` reads them in splits.
    """
    files = _files(spark, path, glob, recursive).filter(F.col("length") <= max_bytes)
    return files.select(
        F.xxhash64("path").alias("log_id"), F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("file_bytes"), F.col("modificationTime").alias("modified_at"),
        decode(F.col("content")).alias("content"))


def rejected_files(spark: SparkSession, path: str | list[str], glob: str | None = None,
                   recursive: bool = True, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files over the limit of whole-file reading, with the reason. Their content is not touched."""
    files = _files(spark, path, glob, recursive).filter(F.col("length") > max_bytes)
    return files.select(
        F.xxhash64("path").alias("log_id"), "path", F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("file_bytes"), F.lit("too_large").alias("reason"))


def read_log_lines(spark: SparkSession, path: str | list[str], glob: str | None = None,
                   max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Numbered lines of every file: whole files up to the limit, larger ones in splits."""
    small = log_lines(read_log_files(spark, path, glob, max_bytes=max_bytes))
    return small.unionByName(read_big_log_lines(spark, path, glob, min_bytes=max_bytes + 1))


def log_lines(files: DataFrame) -> DataFrame:
    """Numbered non-blank lines of ``files(log_id, content)``; numbers count all lines."""
    lines = files.select("log_id", F.posexplode(F.split("content", LINE_BREAK)).alias("_pos", "_line"))
    return lines.filter(~is_blank(F.col("_line"))).select(
        "log_id", (F.col("_pos") + 1).cast("int").alias("line_number"), F.col("_line").alias("raw_line"))


def log_file_stats(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Line count, size in UTF-8 bytes, and why a file is rejected (null when it is not)."""
    text = F.coalesce(F.col("content"), F.lit(""))
    unterminated = F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    size = F.octet_length(text)
    return files.select(
        "log_id",
        (F.regexp_count(text, F.lit("\n")) + unterminated).cast("long").alias("line_count"),
        size.cast("long").alias("file_size_bytes"),
        F.when(is_blank(text), "empty").when(size > max_bytes, "too_large").alias("rejected"))


def read_big_log_lines(spark: SparkSession, path: str | list[str], glob: str | None = None,
                       min_bytes: int = 0) -> DataFrame:
    """Numbered lines of files of any size, read in parallel splits; the numbers are those of `log_lines`.

    Splits end at ``\\n``. A line's number is the lines of the file's earlier
    splits plus its position in its own split. The first pass only counts lines
    per split; the counts are one small row per split, so the join back is
    broadcast when they are few and shuffled otherwise. In files where rarer
    separators break lines too, positions come from a running sum inside each
    split; other files need no such order.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_mid")) \
        .filter(F.col("_size") >= min_bytes)

    def broken(text: Column) -> Column:  # the carriage return before a line feed belongs to the break
        return F.split(F.regexp_replace(text, "\r$", ""), LINE_BREAK)

    latin1 = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    per_split = raw.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_first"), F.sum(F.size(broken(F.col("value")))).alias("_utf8"),
        F.sum(F.size(broken(latin1))).alias("_bytes"), F.count(F.lit(1)).alias("_feeds"),
        F.bool_or(~F.is_valid_utf8("value")).alias("_latin1"))
    whole = Window.partitionBy("_file")
    lines = F.when(F.col("_latin1"), F.col("_bytes")).otherwise(F.col("_utf8"))
    splits = per_split.withColumn("_latin1", F.bool_or("_latin1").over(whole)).withColumn("_lines", lines).select(
        "_file", "_block", "_first", "_latin1", F.bool_or(F.col("_lines") != F.col("_feeds")).over(whole).alias("_odd"),
        F.coalesce(F.sum("_lines").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    pieces = broken(F.when(F.col("_latin1"), latin1).otherwise(F.col("value")))

    def numbered(odd: bool, position: Column) -> DataFrame:
        rows = raw.join(splits.filter(F.col("_odd") == odd), ["_file", "_block"]).withColumn("_pieces", pieces)
        return rows.withColumn("_at", F.col("_before") + position).select(
            "_file", "_at", F.posexplode("_pieces").alias("_pos", "_line"))

    in_split = Window.partitionBy("_file", "_block").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    both = numbered(False, F.col("_mid") - F.col("_first")).unionByName(
        numbered(True, F.coalesce(F.sum(F.size("_pieces")).over(in_split), F.lit(0))))
    number = (F.col("_at") + F.col("_pos") + 1).cast("int")
    line = F.when(number == 1, F.regexp_replace("_line", "^\ufeff", "")).otherwise(F.col("_line"))
    return both.filter(~is_blank(F.col("_line"))).select(
        F.xxhash64("_file").alias("log_id"), number.alias("line_number"), line.alias("raw_line"))
