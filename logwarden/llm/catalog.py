"""The operators as named queries over the given tables, with their expected SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import (chat_format, decontaminate, html_extract, language_id, merkle_manifest, packing, quality, sentence_dedup,
                           simhash, substring_dedup, token_alignment, toxicity, url_filter)
from logwarden.session import ship_package, write_and_read

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]
#: Names of sites that are listed under whatever suffix they stand.
LISTED_NAMES = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents"))


def language_network(docs: DataFrame) -> language_id.Network | None:
    """Fitted on the documents outside the held-out quarter."""
    return language_id.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_id.predict(docs, language_network(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_sentence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_dedup.spans(table(spark, sf, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list: the canonical URLs of the sites (last three labels) with a listed name that ``pages`` knows, and of each of
    their folders. It grows with the pages."""
    url = F.col("url").cast("string")
    rows = pages.select(url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    site = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    known = rows.select(site.alias("site"), "path").filter(F.substring_index("site", ".", 1).isin(*LISTED_NAMES))
    keys = F.array(F.concat("site", F.lit("/")), F.concat("site", F.regexp_extract("path", "^/(?:[^/]*/)*", 0)))
    return known.select(F.explode(keys).alias("key")).filter("key LIKE '%/'").distinct()


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return url_filter.filter_urls(pages, write_and_read(listed_urls(pages), "listed"), URL_RULES) \
        .select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return quality.judge(docs, quality.fit(docs, labels.filter("quality = 1")))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.classes(table(spark, sf, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents")).drop("copy")


def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    chats = chat_format.format_chats(chat_format.gather(rows), "conv_id").withColumn(
        "read", chat_format.parse(F.col("formatted"))).withColumn(
        "loss", chat_format.masked(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("id").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = table(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs.filter(~held_out), table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.counted(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.col("text").cast("string")
    return merkle_manifest.audit(table(spark, sf, "documents"), F.when(tampered, F.replace(text, F.lit("\n"), F.lit("")))
                                 .otherwise(text))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_language_id, op3_decontaminate, op4_html_extract, op5_sentence_dedup, op6_url_filter,
        op7_quality, op8_simhash, op9_packing, op10_chat_format, op11_toxicity, op12_token_alignment,
        op13_merkle_manifest)}


SQL = {}

SQL["op1_suffix_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT r, p, substr(x, 4000 * p + 1, 4398) AS y
           FROM (SELECT r, x, unnest(range(0, CAST(len(x) // 2 - 199 + 1999 AS BIGINT) // 2000)) AS p FROM docs WHERE len(x) >= 400)),
spots AS (SELECT r, 2000 * p + i AS i, md5(substr(y, 2 * i + 1, 400)) AS h
          FROM (SELECT r, p, y, unnest(range(0, CAST(len(y) // 2 - 199 AS BIGINT))) AS i FROM pieces)),
hits AS (SELECT r, i FROM spots WHERE h IN (SELECT h FROM spots GROUP BY h HAVING count(*) > 1)),
edges AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM edges),
spans AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t, b - a AS n, b FROM spans),
kept AS (SELECT r, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY t) AS k, max(b) AS e, sum(n) AS n, count(*) AS c
         FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans,
       sha256(unhex(CASE WHEN e IS NULL THEN x ELSE k || substr(x, 2 * e + 1) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

SQL["op3_decontaminate"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT s.r, s.i, s.n, g.item_id FROM spots s JOIN grams g USING (n, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit
         FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

SQL["op6_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.[^.]+\.[^.]+$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

SQL["op10_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '~', '')) + len(regexp_extract_all(
    text, '<\||</s>|<s>|\[INST\]|\[/INST\]|\|>')) AS inner_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + inner_chars + 10) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])),
      lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS c FROM documents),
parts AS (
  SELECT doc_id, source, text, CASE WHEN c % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS now,
    coalesce(len(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(len(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM marked),
leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, now
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now FROM parts)),
nodes AS (
  SELECT source, 0 AS l, i, leaf AS h FROM leaves
  UNION ALL
  SELECT source, any_value(l) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS m FROM nodes) WHERE m > 1 GROUP BY source, i // 3),
heights AS (SELECT source, max(l) AS top FROM nodes GROUP BY source),
subroots AS (SELECT n.source, h AS subroot, row_number() OVER (ORDER BY n.source NULLS FIRST) - 1 AS i
             FROM nodes n JOIN heights t ON n.source IS NOT DISTINCT FROM t.source AND l = top),
over AS (
  SELECT 0 AS l, i, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(l) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS m FROM over) WHERE m > 1 GROUP BY i // 3),
known AS (
  SELECT row_number() OVER () AS r, v.doc_id, v.source, v.i, v.leaf, v.now, s.i AS si, subroot, top
  FROM leaves v JOIN subroots s ON v.source IS NOT DISTINCT FROM s.source JOIN heights t ON v.source IS NOT DISTINCT FROM t.source),
places AS (
  SELECT r, source, l, i // CAST(3 ** l AS BIGINT) AS z FROM (SELECT *, unnest(range(top)) AS l FROM known)),
steps AS (
  SELECT r, p.l AS l, string_agg(h, '' ORDER BY n.i) FILTER (n.i < z) AS a, string_agg(h, '' ORDER BY n.i) FILTER (n.i > z) AS b
  FROM places p JOIN nodes n ON p.source IS NOT DISTINCT FROM n.source AND p.l = n.l AND n.i // 3 = z // 3 GROUP BY r, p.l
  UNION ALL
  SELECT r, 1000 + n.l, string_agg(h, '' ORDER BY n.i) FILTER (n.i < si // CAST(3 ** n.l AS BIGINT)),
         string_agg(h, '' ORDER BY n.i) FILTER (n.i > si // CAST(3 ** n.l AS BIGINT))
  FROM known JOIN over n ON n.i // 3 = si // CAST(3 ** (n.l + 1) AS BIGINT) AND n.l < (SELECT max(l) FROM over) GROUP BY r, n.l),
proofs AS (
  SELECT r, sha256(string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY l)) AS proof,
         list(coalesce(a, '') || '|' || coalesce(b, '') ORDER BY l) AS s FROM steps GROUP BY r),
folded AS (
  SELECT known.*, coalesce(proof, sha256('')) AS proof_sha256, (SELECT h FROM over ORDER BY l DESC LIMIT 1) AS root,
    list_reduce(list_prepend(now, coalesce(s, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM known LEFT JOIN proofs USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
