"""Exact substring dedup with a suffix order of anchored suffixes, sorted by deep-shallow sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Sorting every suffix of the
corpus would shuffle ``LENGTH`` bytes for each byte of it. Instead each window of ``LENGTH`` bytes is filed under an
anchor: the place in it where the hash of ``GRAM`` bytes is least. Equal windows have their anchors at the same place,
so only anchors meet, one for about 60 bytes.

1. Anchors: gram hash, hash of the context (all windows filed under the anchor), place. One aggregation finds the
   grams that occur twice; it combines in the map tasks. A join brings their anchors back.
2. A gram with one context throughout needs no sorting: its windows are repeated as they are.
3. Of the others each distinct context is taken once. A task gets the contexts of whole grams and sorts the suffixes that
   leave the anchor to the right, and those that leave it to the left, by deep-shallow sorting. A window that reaches
   s bytes left of the anchor is repeated if another context lies in the same run of common prefixes of at least s on
   the left and of the rest on the right. Different contexts are compared by their bytes; which are equal is told by
   their 64-bit hashes, so that two of n contexts of a gram are taken for equal wrongly once in 2**65 / n**2 grams.
4. A gram with more than ``MAX_GROUP`` distinct contexts is not held: its contexts go on to another round, cut by where
   their windows start, under the longer strings that all windows of a cut share. Cuts of one window each are counted by
   an aggregation, so that no task ever holds the surroundings of a passage, however many there are.
5. Repeated windows go back to the members of their contexts and to their texts, where the bytes go.

Texts travel compressed, since they are joined with their findings twice.

Defined results: a null or empty text has no bytes; texts under ``LENGTH`` bytes lose nothing; repeated rows are texts of
their own, so they remove each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import repeatable
from logwarden.llm.deep_shallow import common_prefixes, order_of, words_of
from logwarden.session import write_and_read

LENGTH = 200
GRAM = 64
MAX_GROUP = 50_000
BLOCK = 20_000
SECTION = 1 << 20
CUTS = 8
ANCHORS = "key long, ctx long, row long, spot long"
CONTEXTS = "key long, pk long, pc long, off int, n int, base int, many boolean, bytes binary"
SPANS = "pk long, pc long, spans array<struct<a:int,b:int>>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

U = np.uint64
LOW = U(SECTION * 2 - 1)


# -- anchors ------------------------------------------------------------------

class Rolling:
    """Hashes of any range of a section, from sums of bytes times powers of an odd base modulo 2**64."""

    def __init__(self, base: int, size: int):
        self.powers, self.inverse = (np.multiply.accumulate(
            np.concatenate([[U(1)], np.full(size, x, U)])) for x in (base, pow(base, -1, 1 << 64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([[U(0)], np.cumsum(data.astype(U) * self.powers[:len(data)], dtype=U)])


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Anchors:
    def __init__(self):
        self.grams = Rolling(0x9E3779B97F4A7C15, 2 * SECTION)
        self.contexts = Rolling(0xC2B2AE3D27D4EB4F, 2 * SECTION)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per run of windows with one anchor: gram hash, context hash, text number, first window, windows, bytes before
        the anchor. ``ends`` are the ends of the texts in ``data``; no window crosses one."""
        n, m = len(data) - LENGTH + 1, len(data) - GRAM + 1
        sums = self.grams.sums(data)
        hashes = mixed((sums[GRAM:] - sums[:m]) * self.grams.inverse[:m])
        least = sliding_least((hashes & ~LOW) | np.arange(m, dtype=U), LENGTH - GRAM + 1)
        anchor = (least & LOW).astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        inside = np.zeros(n + 1, np.int64)
        long = ends - begins >= LENGTH
        np.add.at(inside, begins[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(inside)[:n])
        anchor = anchor[at]
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
        first = at[np.concatenate([[0], cut])]
        last = at[np.concatenate([cut, [len(at)]]) - 1]
        anchor = anchor[np.concatenate([[0], cut])]
        sums = self.contexts.sums(data)
        shape = (anchor - first) * LENGTH + last - first
        ctx = mixed((sums[last + LENGTH] - sums[first]) * self.contexts.inverse[first] + mixed(shape.astype(U)))
        text = np.searchsorted(ends, first, "right")
        return hashes[anchor], ctx, text, first - begins[text], last - first + 1, anchor - first


def sections(rows: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, ends, rows and starts of texts, joined to about a section; a longer text comes in overlapping parts."""
    held, owners, begins, size = [], [], [], 0
    for row, text in zip(rows, texts, strict=True):
        if len(text) < LENGTH:
            continue
        for begin in range(0, len(text) - LENGTH + 1, SECTION):
            part = text[begin:begin + SECTION + LENGTH - 1]
            if size and size + len(part) > SECTION:
                yield joined(held, owners, begins)
                held, owners, begins, size = [], [], [], 0
            held.append(part)
            owners.append(row)
            begins.append(begin)
            size += len(part)
    if held:
        yield joined(held, owners, begins)


def joined(held: list[bytes], owners: list[int], begins: list[int]) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]),
            np.array(owners, np.int64), np.array(begins, np.int64))


def anchors(rows: DataFrame) -> DataFrame:
    """Rows (row, text binary) to ``ANCHORS``; spot packs first window, windows and bytes before the anchor."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors()
        for batch in batches:
            for data, ends, owners, begins in sections(*(c.to_pylist() for c in batch.columns)):
                key, ctx, text, first, n, off = find.of(data, ends)
                spot = (first + begins[text] << 16) | (n << 8) | off
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (key.view(np.int64), ctx.view(np.int64), owners[text], spot)],
                    names=[c.split()[0] for c in ANCHORS.split(", ")])

    return rows.mapInArrow(work, ANCHORS)


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """The anchors whose gram occurs more than once; ``ragged`` if it has more than one context.

    The repeated grams are written before the join, so that both of its sides are plain shuffles, of which adaptive execution
    splits the one that a hot gram skews.
    """
    found = anchors(rows)
    grams = found.groupBy("key").agg(F.count("*").alias("times"), F.min("ctx").alias("low"), F.max("ctx").alias("high")) \
        .filter("times > 1").select("key", (F.col("low") != F.col("high")).alias("ragged"))
    return write_and_read(found.join(write_and_read(grams, "grams"), "key"), "anchors")


# -- contexts -----------------------------------------------------------------

def shipped(docs: DataFrame) -> DataFrame:
    """row, doc_id, and the text's bytes compressed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"),
                 pa.array([pack(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["row", "doc_id", "packed"])

    return docs.mapInArrow(work, "row long, doc_id long, packed binary")


def distinct_contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``CONTEXTS``: every distinct context of the ragged grams, once, with its bytes."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(packed)
                out = []
                for w in wanted:
                    first, n, off = w["spot"] >> 16, w["spot"] >> 8 & 255, w["spot"] & 255
                    out.append((w["key"], w["key"], w["ctx"], off, n, 0, w["many"], text[first:first + n - 1 + LENGTH]))
                yield context_batch(out)

    one = repeated.filter("ragged").groupBy("key", "ctx").agg(
        F.count("*").alias("times"), F.min("row").alias("row"), F.min_by("spot", "row").alias("spot"))
    wanted = one.groupBy("row").agg(F.collect_list(F.struct(  # within one text
        "key", "ctx", "spot", (F.col("times") > 1).alias("many"))).alias("wanted"))
    return shipped(docs).join(wanted, "row").select("packed", "wanted").mapInArrow(work, CONTEXTS)


def context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=[c.split()[0] for c in CONTEXTS.split(", ")])


def repeated_windows(group: np.ndarray, off: np.ndarray, n: np.ndarray, many: np.ndarray,
                     contexts: list[bytes]) -> np.ndarray:
    """For every context and every reach s to the left of the anchor: whether that window is repeated."""
    right = words_of([c[o:] for c, o in zip(contexts, off.tolist(), strict=True)], LENGTH)
    left = words_of([c[:o][::-1] for c, o in zip(contexts, off.tolist(), strict=True)], -(-(LENGTH - GRAM) // 8) * 8)
    sides = []
    for words in (left, right):
        order = order_of(words, group)
        sides.append((order, common_prefixes(words, group, order)))
    reach = int(off.max()) + 1
    repeated = np.zeros((len(contexts), reach), bool)
    for s in range(reach):
        here = np.flatnonzero((s <= off) & (off - s < n))
        runs = []
        for (order, shared), least in zip(sides, (s, LENGTH - s), strict=True):
            run = np.empty(len(order), np.int64)
            run[order] = np.cumsum(shared < least)
            runs.append(run[here])
        _, same, times = np.unique(runs[0] * (len(contexts) + 1) + runs[1], return_inverse=True, return_counts=True)
        repeated[here, s] = (times[same] > 1) | many[here]
    return repeated


def spans_of(repeated: np.ndarray, off: np.ndarray, base: np.ndarray) -> list[list[tuple[int, int]]]:
    """The byte ranges that repeated windows cover, from the context's begin."""
    edges = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(repeated))]
    rows, begins = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    for i, s, t in zip(rows.tolist(), begins.tolist(), ends.tolist(), strict=True):  # reaches s to t - 1
        spans[i].append((int(base[i] + off[i] - t + 1), int(base[i] + off[i] - s + LENGTH)))
    return spans


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[dict], bool]]:
    """Blocks of whole grams from batches sorted by gram; a gram beyond ``most`` comes in parts that are not whole."""
    block, gram, key, cut = [], [], None, False
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if cut:
                    yield gram, False
                else:
                    block += gram
                    if len(block) >= BLOCK:
                        yield block, True
                        block = []
                gram, key, cut = [], row["key"], False
            gram.append(row)
            if len(gram) > most:
                yield gram, False
                gram, cut = [], True
    if cut:
        yield gram, False
    else:
        block += gram
    if block:
        yield block, True


def sort_contexts(contexts: DataFrame, most: int) -> DataFrame:
    """Contexts to ``SPANS`` and, for grams that are too large, to contexts again (``again``)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in groups_of(batches, most):
            if not whole:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), SPAN_LIST),
                     pa.array(rows, pa.struct(list(context_batch([]).schema)))], names=["pk", "pc", "spans", "again"])
                continue
            off, n, base = (np.array([r[c] for r in rows]) for c in ("off", "n", "base"))
            group = np.unique([r["key"] for r in rows], return_inverse=True)[1]
            many = np.array([r["many"] for r in rows])
            spans = spans_of(repeated_windows(group, off, n, many, [r["bytes"] for r in rows]), off, base)
            found = [(r["pk"], r["pc"], [{"a": a, "b": b} for a, b in s]) for r, s in zip(rows, spans, strict=True) if s]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], SPAN_LIST),
                 pa.nulls(len(found), pa.struct(list(context_batch([]).schema)))], names=["pk", "pc", "spans", "again"])

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "key").sortWithinPartitions("key") \
        .mapInArrow(work, f"{SPANS}, again struct<{CONTEXTS.replace(' ', ':').replace(',:', ',')}>")


SPAN_LIST = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def cut_contexts(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts cut by the reach of their windows, in steps of ``width``, under the string all windows of a cut share."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                off, n = r["off"], r["n"]
                for low in range((off - n + 1) // width * width, off + 1, width):
                    high = low + width - 1
                    first, last = max(off - high, 0), min(off - low, n - 1)
                    core = r["bytes"][max(off - low, 0):off - high + LENGTH]
                    key = xxhash.xxh64_intdigest(core, seed=r["key"] + low & 0xFFFFFFFF)
                    out.append((key - (1 << 64) if key >> 63 else key, r["pk"], r["pc"], off - first, last - first + 1,
                                r["base"] + first, r["many"], r["bytes"][first:last + LENGTH]))
            yield context_batch(out)

    return contexts.mapInArrow(work, CONTEXTS)


def repeated_spans(contexts: DataFrame, max_group: int) -> DataFrame:
    """``SPANS`` of all contexts; rounds end when a cut is one window, which needs no sorting: see ``single_windows``."""
    found, width, done = contexts, LENGTH - GRAM + 1, None
    while True:
        result = write_and_read(sort_contexts(found, max_group), "spans")
        part = result.filter("again IS NULL").select("pk", "pc", "spans")
        done = part if done is None else done.unionByName(part)
        left = result.filter("again IS NOT NULL").select("again.*")
        if left.isEmpty():
            return done
        width = max(1, -(-width // CUTS))
        found = cut_contexts(left, width)
        if width == 1:
            return done.unionByName(single_windows(found))


def single_windows(contexts: DataFrame) -> DataFrame:
    """``SPANS`` of contexts of one window each: strings are counted, not held, however many rows have the same one.

    Counts combine on the map side and are written before the join, whose other side adaptive execution may split.
    """
    rows = write_and_read(contexts.select("key", "pk", "pc", "base", "many", "bytes"), "windows")
    times = write_and_read(rows.groupBy("key", "bytes").agg(
        ((F.count("*") > 1) | F.bool_or("many")).alias("repeated")).filter("repeated").select("key", "bytes"), "repeated")
    span = F.struct(F.col("base").alias("a"), (F.col("base") + LENGTH).alias("b"))
    return rows.join(times, ["key", "bytes"]).select("pk", "pc", F.array(span).alias("spans"))


# -- texts --------------------------------------------------------------------

def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, max_group: int = MAX_GROUP, with_kept: bool = False) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` if asked (the bytes left)."""
    result = RESULT + ", kept binary" * with_kept
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, len(batch), 500):
                out = []
                for doc, packed, spans in zip(*(c.to_pylist() for c in batch.slice(first, 500).columns), strict=True):
                    text = unpack(packed)
                    gone = merged([(s["a"], s["b"]) for s in spans or ()])
                    kept = without(text, gone)
                    out.append((doc, len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(),
                                *([kept] if with_kept else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds)],
                                                 names=[c.split()[0] for c in result.split(", ")])

    docs = repeatable(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col("`text`").cast("string"), F.lit("")), "UTF-8").alias("text"))
    repeated = repeated_anchors(rows.select("row", "text"))
    first, n = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(255))
    plain = repeated.filter("NOT ragged").select("row", F.array(F.struct(
        first.alias("a"), (first + n - 1 + LENGTH).alias("b"))).alias("spans"))
    spans = repeated_spans(distinct_contexts(rows, repeated), max_group)
    ragged = repeated.filter("ragged").join(spans, (F.col("key") == F.col("pk")) & (F.col("ctx") == F.col("pc"))).select(
        "row", F.transform("spans", lambda s: F.struct((first + s["a"]).alias("a"), (first + s["b"]).alias("b"))).alias("spans"))
    found = plain.unionByName(ragged).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # one text's
    return shipped(rows).join(found, "row", "left").select("doc_id", "packed", "spans").mapInArrow(work, result)
