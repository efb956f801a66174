"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A benchmark
window is 13 consecutive item words, or the whole item if it has fewer words (but one at least).

1. The distinct windows of the benchmark are counted, with their characters. Up to ``MAX_WINDOWS`` windows and
   ``MAX_CHARS`` characters they are shipped as constants: a set of 64-bit hashes and the set of window texts. Beyond
   that the windows stay a table and document windows meet them in a hash join.
2. A document's windows are scanned inside its row: the hash of each window is looked up in the set, and a hit counts
   only if the window's words are equal too.
3. A word inside any occurring window is hit. Items are found by joining the few verified hits with the window table.

Defined results: a null, empty or wordless text has no words and no hits; a null or wordless item has no window; equal
items all count; repeated document rows are judged one by one; an empty benchmark hits nothing; extra columns of either
table are ignored by ``scan`` and kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import ascii_lower, bind, once, only, repeatable, split_words, starts

WIDTH = 13
MAX_WINDOWS = 50_000
MAX_CHARS = 8_000_000
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
GAP_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), GAP, GAP_CHARS)


def windows_of(words: Column, width: int) -> Column:
    """All windows of a word array, or the array itself as the only one if it is shorter; as texts."""
    return F.when(F.size(words) >= width, F.transform(
        starts(F.size(words), width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))) \
        .when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per item and distinct window: item_id, n (its words), gram, h."""
    words = only(benchmark, item_id="string", text="string").select("item_id", once(words_of(F.col("text"))).alias("words"))
    return words.select("item_id", F.explode(F.array_distinct(windows_of(F.col("words"), width))).alias("gram")) \
        .withColumn("n", F.size(F.split("gram", " "))).withColumn("h", F.xxhash64("gram"))


Shipped = dict[int, list[tuple[str, int]]]  # words per window -> (text, hash)


def ship(windows: DataFrame, max_windows: int = MAX_WINDOWS, max_chars: int = MAX_CHARS) -> Shipped | None:
    """The windows as constants, or None if they are more than the bounds allow."""
    distinct = windows.select("n", "gram", "h").distinct()
    count, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()
    if count > max_windows or chars > max_chars:
        return None
    grams: Shipped = {}
    for n, gram, h in distinct.orderBy("n", "gram").collect():  # bounded by the check above
        grams.setdefault(n, []).append((gram, h))
    return grams


def gram_at(words: Column, i: Column, n: int) -> Column:
    return F.array_join(F.slice(words, i + 1, n), " ")


def occurring(words: Column, shipped: Shipped) -> Column:
    """Occurrences of shipped windows in a word array: array of (pos, n, gram), verified by their words."""
    found = F.array().cast("array<struct<pos:int,n:int,gram:string>>")
    for n, known in sorted(shipped.items()):
        found = F.concat(found, occurring_of(words, n, [g for g, _ in known], [h for _, h in known]))
    return found


def occurring_of(words: Column, n: int, grams: list[str], hashes: list[int]) -> Column:
    places = F.filter(starts(F.size(words), n), lambda i: bind(
        gram_at(words, i, n), lambda gram: F.xxhash64(gram).isin(hashes) & gram.isin(grams)))
    return F.transform(places, lambda i: F.struct(
        i.cast("int").alias("pos"), F.lit(n).cast("int").alias("n"), gram_at(words, i, n).alias("gram")))


def covered(occurrences: Column) -> Column:
    """The number of words inside any occurrence."""
    each = F.transform(occurrences, lambda o: F.sequence(o["pos"], o["pos"] + o["n"] - 1))
    return F.size(F.array_distinct(F.flatten(each))).cast("long")


def all_spots(words: Column, n: int) -> Column:
    return F.transform(starts(F.size(words), n), lambda i: F.struct(
        i.cast("int").alias("pos"), F.lit(n).cast("int").alias("n"), gram_at(words, i, n).alias("gram")))


def with_occurrences(docs: DataFrame, windows: DataFrame, shipped: Shipped | None) -> DataFrame:
    """``docs`` (with ``words``) and the column ``found``: the verified occurrences of each row."""
    if shipped is not None:
        return docs.withColumn("found", once(occurring(F.col("words"), shipped)))
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    sizes = [r[0] for r in windows.select("n").distinct().collect()]  # at most WIDTH numbers
    every = F.flatten(F.array(*(all_spots(F.col("words"), n) for n in sizes)))
    spots = rows.select("_row", F.explode(every).alias("spot")).withColumn("h", F.xxhash64("spot.gram"))
    known = windows.select("h", "gram").distinct()
    hits = spots.join(known, (spots["h"] == known["h"]) & (spots["spot.gram"] == known["gram"]), "left_semi") \
        .groupBy("_row").agg(F.array_sort(F.collect_list("spot")).alias("found"))  # within one document
    return rows.join(hits, "_row", "left").drop("_row").withColumn("found", F.coalesce(
        "found", F.array().cast("array<struct<pos:int,n:int,gram:string>>")))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, item_ids (sorted strings), contaminated."""
    windows = benchmark_windows(benchmark, width)
    words = only(repeatable(docs), doc_id="long", text="string").select("doc_id", once(words_of(F.col("text"))).alias("words"))
    found = with_occurrences(words, windows, ship(windows, max_windows)).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "found")
    rows = found.select("doc_id", "n_words", once(covered(F.col("found"))).alias("n_hit"), F.array_distinct(
        F.transform("found", lambda o: o["gram"])).alias("grams"))
    items = windows.groupBy("gram").agg(F.collect_set("item_id").alias("items"))  # item ids of one window
    hits = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram")).join(items, "gram", "left")
    return hits.select("_row", "doc_id", "n_words", "n_hit", F.explode_outer("items").alias("item")) \
        .groupBy("_row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("item_ids")) \
        .drop("_row").withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def judged(docs: DataFrame, benchmark: DataFrame, width: int, max_windows: int) -> DataFrame:
    """``docs`` as they are, nested under ``doc``, with words and occurrences beside them."""
    windows = benchmark_windows(benchmark, width)
    rows = repeatable(docs).select(F.struct("*").alias("doc"), once(words_of(F.col("`text`"))).alias("words"))
    return with_occurrences(rows, windows, ship(windows, max_windows))


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                     max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    rows = judged(docs, benchmark, width, max_windows)
    return rows.filter(~is_contaminated(covered(F.col("found")), F.size("words"))).select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                 max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with hit words cut out of ``text``; a changed text becomes its other words (lower-cased), space-joined."""
    rows = judged(docs, benchmark, width, max_windows)
    gone = F.flatten(F.transform("found", lambda o: F.sequence(o["pos"], o["pos"] + o["n"] - 1)))
    places = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), gone)
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("words"), i)), " ")
    text = F.when(F.size("found") == 0, F.col("doc.text")).otherwise(left)
    return rows.withColumn("_text", text).select(
        *(F.col("_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
