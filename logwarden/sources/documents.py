"""Knowledge files to documents: text, Markdown, logs, JSON and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.text import is_blank, strip
from logwarden.schemas import SOURCE_TYPES
from logwarden.sources.logs import LINE_BREAK

# Extensions, folder aliases, severity aliases, JSON keys.
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".log", ".rst")
JSON_EXTENSIONS = (".json", ".jsonl")
FOLDER_ALIASES = {"playbooks": "playbook", "advisories": "cisa", "vulnerabilities": "nvd",
                  "techniques": "mitre", "rules": "sigma"}
SEVERITY_ALIASES = {"informational": "info", "critical": "critical", "high": "high", "medium": "medium",
                    "moderate": "medium", "low": "low", "info": "info"}
CONTENT_KEYS = ("content", "text", "description", "body", "summary", "details", "narrative", "rule", "definition")
FALLBACK_EXCLUDED = ("id", "_id", "hash", "embedding", "vector", "embeddings")
NOT_METADATA = (*CONTENT_KEYS, *FALLBACK_EXCLUDED, "source_url", "url", "link", "technique_id", "cve_id",
                "cveId", "severity", "baseSeverity")
TECHNIQUE_ID = r"(?U)(?<![\w])(T\d{4}(?:\.\d{3})?)(?![.\d])"
CVE_ID = r"(?iU)\b(CVE-\d{4}-\d{4,7})\b"


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(filename(path), r".(\.[^.]*)$", 1))


def infer_source_type(path: Column) -> Column:
    """The first path part that names a source type (or its plural folder)."""
    names = {**{s: s for s in SOURCE_TYPES}, **FOLDER_ALIASES}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    part = F.get(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(*names)), F.lit(0))
    return F.coalesce(F.try_element_at(known, part), F.lit("custom"))


def _first_match(path: Column, content: Column, pattern: str) -> Column:
    def find(text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return F.coalesce(find(stem(path)), find(content))


def infer_technique_id(path: Column, content: Column) -> Column:
    return _first_match(path, content, TECHNIQUE_ID)


def infer_cve_id(path: Column, content: Column) -> Column:
    return F.upper(_first_match(path, content, CVE_ID))


def normalise_severity(raw: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in SEVERITY_ALIASES.items() for x in pair])
    return F.try_element_at(aliases, F.lower(strip(raw)))


def doc_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Whole text files: path and content, from all sub-folders."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("content"))


def text_docs(files: DataFrame) -> DataFrame:
    """One document per text file of ``files(path, content)``; blank files give none."""
    content = strip(F.col("content"))
    rows = files.filter(extension(F.col("path")).isin(*TEXT_EXTENSIONS) & ~is_blank(F.col("content")))
    rows = rows.select("path", content.alias("content"))
    path = F.col("path")
    return rows.select(
        "content", path.alias("source_path"), infer_source_type(path).alias("source_type"),
        F.lit(None).cast("string").alias("source_url"), doc_hash(F.col("content")).alias("doc_hash"),
        infer_technique_id(path, F.col("content")).alias("technique_id"),
        infer_cve_id(path, F.col("content")).alias("cve_id"), F.lit(None).cast("string").alias("severity"),
        F.create_map(F.lit("filename"), filename(path), F.lit("file_extension"), extension(path),
                     F.lit("loader"), F.lit("text")).alias("metadata"))


def json_objects(files: DataFrame) -> DataFrame:
    """JSON objects of whole files: the root, list items, or the non-blank lines.

    Output ``path, item, jsonl_line, object, error``. A bad JSON line is left
    out; a bad .json file gives one row with ``error``.
    """
    path, content = F.col("path"), F.col("content")
    is_lines = extension(path) == ".jsonl"
    by_line = (files.filter(is_lines)
               .select("path", F.posexplode(F.split("content", LINE_BREAK)).alias("item", "object"))
               .select("path", "item", (F.col("item") + 1).alias("jsonl_line"), strip(F.col("object")).alias("object"))
               .filter(F.col("object").startswith("{") & F.try_parse_json("object").isNotNull())
               .withColumn("error", F.lit(None).cast("string")))
    whole = files.filter(extension(path) == ".json").withColumn("_v", F.try_parse_json(content))
    items = F.when(strip(content).startswith("["), F.transform(
        F.from_json(content, "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(content))
    good = (whole.filter(F.col("_v").isNotNull())
            .select("path", F.posexplode(items).alias("item", "object"))
            .filter(strip(F.col("object")).startswith("{"))
            .select("path", "item", F.lit(None).cast("int").alias("jsonl_line"), "object",
                    F.lit(None).cast("string").alias("error")))
    bad = whole.filter(F.col("_v").isNull()).select(
        "path", F.lit(0).alias("item"), F.lit(None).cast("int").alias("jsonl_line"),
        F.lit(None).cast("string").alias("object"), F.lit("Invalid JSON").alias("error"))
    return by_line.unionByName(good).unionByName(bad)


def json_docs(objects: DataFrame) -> DataFrame:
    """Documents of JSON objects (``path, jsonl_line, object`` and perhaps ``item``).

    Content is the first non-blank text among the content keys, else the scalar
    fields as JSON. Other scalar fields become metadata (as text).
    """
    path = F.col("path")
    item = F.col("item") if "item" in objects.columns else F.lit(None)
    fields = objects.filter(F.col("object").isNotNull()).select(
        "path", "jsonl_line", item.cast("string").alias("_item"), F.from_json("object", "map<string,variant>").alias("_fields"))

    def kind(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def is_scalar(v: Column) -> Column:
        return ~kind(v).rlike("^(OBJECT|ARRAY|VOID)")

    def value(key: str) -> Column:
        return F.try_element_at(F.col("_fields"), F.lit(key))

    def text(key: str) -> Column:
        """A text field, null for other types and for blank text."""
        v = value(key)
        t = F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.when(~is_blank(t), strip(t))

    def scalar(key: str) -> Column:
        v = value(key)
        return F.nullif(F.when(is_scalar(v), F.try_variant_get(v, "$", "string")), F.lit(""))

    rest = F.map_filter("_fields", lambda k, v: ~k.isin(*FALLBACK_EXCLUDED) & is_scalar(v))
    lines = F.transform(F.map_entries(rest), lambda e: F.concat(
        F.lit('  '), F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6),
        F.lit(": "), F.to_json(e["value"])))
    fallback = F.when(F.size(rest) > 0, F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))
    content = F.coalesce(*[text(k) for k in CONTENT_KEYS], fallback)
    # a generator drops the rows without content and keeps the filter from repeating the lookups
    rows = fields.select("*", F.explode(F.array_compact(F.array(content))).alias("content"))

    metadata = F.transform_values(
        F.map_filter("_fields", lambda k, v: ~k.isin(*NOT_METADATA, "filename", "loader", "jsonl_line", "item") & is_scalar(v)),
        lambda k, v: F.try_variant_get(v, "$", "string"))
    base = F.create_map(F.lit("filename"), filename(path), F.lit("loader"), F.lit("json"), F.lit("item"), F.col("_item"))
    line = F.when(F.col("jsonl_line").isNotNull(), F.create_map(F.lit("jsonl_line"), F.col("jsonl_line").cast("string"))) \
            .otherwise(F.create_map().cast("map<string,string>"))
    own_id = F.when(scalar("id").rlike(r"(?iU)^CVE-\d{4}-\d{4,}\b"), scalar("id"))  # a CVE number may have any number of digits
    return rows.select(
        "content", path.alias("source_path"), infer_source_type(path).alias("source_type"),
        F.coalesce(scalar("source_url"), scalar("url"), scalar("link")).alias("source_url"),
        doc_hash(F.col("content")).alias("doc_hash"),
        F.coalesce(scalar("technique_id"), scalar("techniqueId"), infer_technique_id(path, F.col("content"))).alias("technique_id"),
        F.upper(F.coalesce(own_id, scalar("cve_id"), scalar("cveId"), infer_cve_id(path, F.col("content")))).alias("cve_id"),
        normalise_severity(F.coalesce(text("severity"), text("baseSeverity"))).alias("severity"),
        F.map_concat(base, line, metadata).alias("metadata"))


def read_text_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return text_docs(read_files(spark, path))


def read_json_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents of .json and .jsonl files; each file is read whole."""
    return json_docs(json_objects(read_files(spark, path, "*.json*")))


def read_jsonl_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents of large .jsonl files, read in parallel splits by line.

    Without line numbers in the metadata; bad lines are left out.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("int").alias("jsonl_line"),
                     strip(F.make_valid_utf8("value")).alias("object")))
    return json_docs(lines.filter(F.col("object").startswith("{") & F.try_parse_json("object").isNotNull()))
