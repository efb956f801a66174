"""SimHash near-duplicates by deletion-variant signatures.

1. A text's shingles are runs of ``width`` words (A-Z lower-cased). Their XXH64 hashes come from Spark; bits are counted
   per document in Arrow batches. A fingerprint bit is 1 if more than half of the hashes have it.
2. Fingerprints that differ in at most 3 bits agree, but for one bit at most, in one half of 32 bits. Each distinct
   fingerprint is indexed under both halves with every single bit masked out: 64 variants. Equal variants meet.
3. A group of equal variants is verified inside its task: the group's links are found and a spanning forest of them is
   returned, never all pairs. Large groups are cut further by the same rule on the bits that are still free, and pairs
   that are already connected are not looked at again.
4. A group of more than ``max_group`` fingerprints is not held: its rows go on to a second round under variants of the
   other half as well, whose groups share 46 bits and so hold at most 2**18 fingerprints.
5. Components of the links give every document the least doc_id of its class.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; fewer words than
``width`` are one shingle; repeated rows share a class; a null doc_id gets a class but is no class's id unless alone; an
empty table gives no rows; extra columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import ascii_lower, once, only, repeatable, space_words, starts
from logwarden.llm.components import components
from logwarden.session import write_and_read

WIDTH = 3
DISTANCE = 3
MAX_GROUP = 200_000
PAIRWISE = 400
HASHES_AT_ONCE = 200_000
BITS_AT_ONCE = 16_384  # hashes whose bits are counted at once: 64 whole numbers of eight bytes each
HALVES = ((32, 0xFFFFFFFF00000000), (0, 0x00000000FFFFFFFF))
FOUND = "a long, b long, variant long"  # variant: null for a link a-b, else the group that fingerprint a is left in


# -- fingerprints -------------------------------------------------------------

def shingle_hashes(words: Column, width: int) -> Column:
    each = F.transform(starts(F.size(words), width), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, width), " ")))
    return F.when(F.size(words) >= width, each).when(
        F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def majority_bits(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of 64-bit hashes; row i has values[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    counts = np.zeros((len(sizes), 64), np.int64)
    for first in range(int(offsets[0]), int(offsets[-1]), BITS_AT_ONCE):
        last = min(first + BITS_AT_ONCE, int(offsets[-1]))
        begin = np.searchsorted(offsets, first, "right") - 1
        end = np.searchsorted(offsets, last, "left")
        rows = np.arange(begin, end)
        rows = rows[sizes[rows] > 0]
        bits = np.unpackbits(values[first:last].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.maximum(offsets[rows], first) - first
        counts[rows] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``_row``, doc_id and fp (64 bits as a long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            fps = majority_bits(lists.values.to_numpy(), lists.offsets.to_numpy()) if len(lists) else np.zeros(0, "<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["_row", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("`doc_id`").cast("long").alias("doc_id"),
                       once(space_words(ascii_lower(F.col("`text`").cast("string")))).alias("words"))
    return rows.select("_row", "doc_id", shingle_hashes(F.col("words"), width).alias("hashes")) \
        .mapInArrow(run, "_row long, doc_id long, fp long")


# -- links --------------------------------------------------------------------

class Forest:
    """Union-find over positions, keeping the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= DISTANCE


def link_group(fps: np.ndarray, at: np.ndarray, free: list[int], forest: Forest) -> None:
    """Link the fingerprints at ``at``, which agree in all but the ``free`` bits."""
    if len(at) <= PAIRWISE:
        values = fps[at]
        for i, j in np.argwhere(np.triu(near(values[:, None], values[None, :]), 1)).tolist():
            forest.link(int(at[i]), int(at[j]))
        return
    middle = len(free) // 2
    for half, other in ((free[:middle], free[middle:]), (free[middle:], free[:middle])):
        for masked in half:
            mask = np.uint64(sum(1 << b for b in half if b != masked))
            keys = fps[at] & mask
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1 and len({forest.root(i) for i in at[part].tolist()}) > 1:
                    link_group(fps, at[part], [*other, masked], forest)


def variants(fps: Column) -> Column:
    """The 64 variants of a fingerprint: half, masked bit, and the other 31 bits of the half."""
    def of(half: int, shift: int) -> Column:
        value = F.shiftrightunsigned(fps, shift).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: value.bitwiseAND(F.bitwise_not(
            F.call_function("shiftleft", F.lit(1).cast("long"), b))).bitwiseOR(
            F.call_function("shiftleft", F.lit(half * 32).cast("long") + b, F.lit(32))))
    return F.concat(of(0, 0), of(1, 32))


def finer(variant: Column, fps: Column) -> Column:
    """Hashes of a variant together with the one-bit-masked quarters of the half it leaves free."""
    shift = F.when(F.shiftrightunsigned(variant, 37) == 0, 32).otherwise(0)
    value = F.when(shift == 32, F.shiftrightunsigned(fps, 32)).otherwise(fps).bitwiseAND(F.lit(0xFFFFFFFF))

    def of(quarter: int) -> Column:
        bits = F.shiftrightunsigned(value, 16 * quarter).bitwiseAND(F.lit(0xFFFF))
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.xxhash64(
            variant, F.lit(quarter), b, bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b)))))
    return F.concat(of(0), of(1))


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """Runs of equal variants from sorted batches: variant, pieces of its fingerprints, whether the run is complete.

    A run beyond ``most`` is handed out in parts that are not complete, so that it is never held.
    """
    key, held, size, cut = None, [], 0, False
    for batch in batches:
        variants_, fps = (batch.column(c).to_numpy() for c in ("variant", "fp"))
        if not len(fps):
            continue
        edges = np.flatnonzero(np.diff(variants_)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
            if variants_[first] != key:
                if size > 1 or cut:
                    yield key, held, not cut
                key, held, size, cut = variants_[first], [], 0, False
            held.append(fps[first:last])
            size += last - first
            if size > most:
                yield key, held, False
                held, size, cut = [], 0, True
    if size > 1 or cut:
        yield key, held, not cut


def links_of(rows: DataFrame, max_group: int | None) -> DataFrame:
    """Rows (variant, fp) to ``FOUND``: a spanning forest of the links of every group, or its rows if it is too large."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, left = [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, left)], names=["a", "b", "variant"])
            for x in (a, b, left):
                x.clear()
            return batch

        for key, held, whole in groups_of(batches, max_group or 1 << 62):
            fps = np.unique(np.concatenate(held).view(np.uint64)) if held else np.zeros(0, np.uint64)
            if whole and len(fps) == 2:
                if near(fps[0], fps[1]):
                    links = [(0, 1)]
                else:
                    continue
            elif whole:
                forest = Forest(len(fps))
                link_group(fps, np.arange(len(fps)), list(range(64)), forest)
                links = forest.links
            signed = fps.view(np.int64).tolist()
            if whole:
                a += [signed[i] for i, _ in links]
                b += [signed[j] for _, j in links]
                left += [None] * len(links)
            else:
                a += signed
                b += signed
                left += [int(key)] * len(signed)
            if len(a) > 50_000:
                yield out()
        yield out()

    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(parts), "variant").sortWithinPartitions("variant").mapInArrow(run, FOUND)


def link_fingerprints(fps: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (a, b) that connect all fingerprints (``fp``, distinct) within the distance."""
    found = write_and_read(links_of(fps.select("fp", F.explode(variants(F.col("fp"))).alias("variant")), max_group), "links")
    again = found.filter("variant IS NOT NULL").select(
        F.col("a").alias("fp"), F.explode(finer(F.col("variant"), F.col("a"))).alias("variant"))
    return found.filter("variant IS NULL").select("a", "b").unionByName(links_of(again, None).select("a", "b"))


# -- classes ------------------------------------------------------------------

def row_classes(docs: DataFrame, width: int = WIDTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: _row, doc_id, fp, component_id, first (``_row`` of the class's row that stays)."""
    rows = write_and_read(fingerprints(docs, width), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    fps = write_and_read(rows.groupBy("fp").agg(least), "distinct")
    roots = components(link_fingerprints(fps.select("fp"), max_group))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = rooted.join(classes, "root").select("fp", F.col("first.doc_id").alias("component_id"),
                                                F.col("first._row").alias("first"))
    return rows.join(by_fp, "fp").select("_row", "doc_id", "fp", "component_id", "first")


def classes(docs: DataFrame, width: int = WIDTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id."""
    return row_classes(docs, width, max_group).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with one row of each class, the one of least doc_id; all columns kept."""
    docs = repeatable(docs)
    stay = row_classes(docs, width, max_group).filter("_row = first").select(F.col("_row").alias("_keep"))
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"))
    return rows.join(stay, rows["_row"] == stay["_keep"], "left_semi").select("doc.*")
