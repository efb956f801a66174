"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

1. Texts are encoded by a byte-level BPE (A) and a sentence-piece model (B); each token is a run of bytes of space + text.
   ``A`` (tokens x bytes) and ``B`` (tokens x bytes) say which token holds which byte, as compressed sparse rows built by
   hand from the tokens' lengths; the texts of a batch are blocks on the diagonal.
2. Gustavson's row products give ``A B^T``: for each byte of an A token, the row of that byte in ``B^T`` is added up. Its
   entries are the overlap links, their values the bytes that two tokens share.
3. Offsets where an A and a B token both end cut the tokens into groups. The group incidences (tokens x groups) give the
   links of tokens in one group by ``G_A G_B^T``, in blocks of rows; their number alone comes from row sums.
4. Links are counted per pair of ids: first in the batch, then over the corpus in one aggregation. The totals of a batch's
   pairs come back to it by a join on the pair, and one more sparse product, documents x pairs, sums them per document. So
   what is shuffled are the distinct pairs of batches, never links of documents.

Defined results: null and empty texts, and texts whose tokens do not give back space + text (such as those with U+2581,
which B takes for a space), have no tokens, no links and an empty ``groups_sha256``; strings of special tokens are plain
text; long texts make batches of their own; equal pairs count for each occurrence, repeated rows included; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import only
from logwarden.session import write_and_read

#: Bytes of text that share one table of pairs. Fewer mean more rows to shuffle, more mean more memory.
BATCH_BYTES = 8_000_000
#: Bytes of text whose matrices are held at once.
BLOCK_BYTES = 500_000
LINKS_AT_ONCE = 1_000_000
#: Fixed value: how a byte-level vocabulary cuts a text before it merges.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string"
FOUND = f"batch long, doc_id long, {MEASURES}, steps array<int>, times array<int>, pair long, links long"
COUNTED = f"doc_id long, {MEASURES}, n_best long, count_sum long"
LINKS = "doc_id long, kind string, a_at long, b_at long, a_id int, b_id int, shared_bytes long"


# -- sparse rows --------------------------------------------------------------

@dataclass(frozen=True)
class Rows:
    """A sparse matrix by compressed rows: row i has columns at[starts[i]:starts[i + 1]] with those values."""

    starts: np.ndarray
    at: np.ndarray
    values: np.ndarray
    n_columns: int

    @property
    def of_entries(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def part(self, first: int, last: int) -> "Rows":
        a, b = self.starts[first], self.starts[last]
        return Rows(self.starts[first:last + 1] - a, self.at[a:b], self.values[a:b], self.n_columns)


def row_product(a: Rows, b: Rows) -> Rows:
    """``a b`` by Gustavson: row i of the product is the sum of the rows of ``b`` that row i of ``a`` names, weighted."""
    counts = np.diff(b.starts)[a.at]
    ends = np.cumsum(counts)
    entries = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b.starts[a.at] - (ends - counts), counts)
    keys = np.repeat(a.of_entries, counts) * b.n_columns + b.at[entries]
    values = np.repeat(a.values, counts) * b.values[entries]
    if (keys[1:] < keys[:-1]).any():  # a row's sum meets columns out of order
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values, firsts) if len(keys) else values
    rows, at = np.divmod(keys[firsts], max(b.n_columns, 1))
    return Rows(np.append(0, np.cumsum(np.bincount(rows, minlength=len(a.starts) - 1))), at, sums, b.n_columns)


def incidence(lengths: np.ndarray) -> Rows:
    """Tokens x bytes: the tokens lie end to end."""
    starts = np.append(0, np.cumsum(lengths))
    return Rows(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def transposed_incidence(lengths: np.ndarray) -> Rows:
    """Bytes x tokens: each byte lies in one token."""
    n = int(lengths.sum())
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64), len(lengths))


def memberships(groups: np.ndarray, n_groups: int) -> tuple[Rows, Rows]:
    """Tokens x groups and groups x tokens; tokens come in the order of their groups."""
    ones, each = np.ones(len(groups), np.int64), np.arange(len(groups))
    return (Rows(np.arange(len(groups) + 1), groups, ones, n_groups),
            Rows(np.searchsorted(groups, np.arange(n_groups + 1)), each, ones, len(groups)))


# -- the two tokenizers -------------------------------------------------------

def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest in turn from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes and names of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(a_path, encoding="utf-8") as file:
            described = json.load(file)
        letters, specials = byte_of_letter(), {t["content"] for t in described["added_tokens"]}
        ids = {bytes(letters[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in specials}
        # merges are numbered in the order of their ranks, so the ids are the ranks
        self.a = Encoding(a_path, pat_str=PIECES, mergeable_ranks=ids, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = max(ids.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in ids.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n_b)]
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        #: An id with what follows it: "," or "|" after A ids, "," or ";" after B ids.
        self.written = [f"{i}{mark}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A of space + text, and by B of the text; none where either does not give the bytes back."""
        known = [t or "" for t in texts]
        a = [self.a.encode_ordinary(f" {t}") for t in known]
        b = self.b.encode(known, num_threads=1)
        none: list[int] = []
        for k, text in enumerate(known):
            whole = f" {text}".encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a[k])) != whole \
                    or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                a[k] = b[k] = none
        return [np.array(x, np.int64) for x in a], [np.array(x, np.int64) for x in b]


@lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


# -- one block of texts -------------------------------------------------------

@dataclass(frozen=True)
class Block:
    """The alignment of some texts, as blocks on the diagonal. ``a_ends`` and ``b_ends`` count tokens up to each text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    links: Rows
    a_groups: np.ndarray
    b_groups: np.ndarray
    n_groups: int

    @staticmethod
    def of(pair: Pair, a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> "Block":
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a_ids, b_ids))
        a_lengths, b_lengths = pair.a_lengths[a], pair.b_lengths[b]
        links = row_product(incidence(a_lengths), transposed_incidence(b_lengths))
        a_stops, b_stops = np.cumsum(a_lengths), np.cumsum(b_lengths)
        a_last, b_last = np.isin(a_stops, b_stops), np.isin(b_stops, a_stops)  # the last token of a group
        return Block(a, b, np.cumsum([0, *map(len, a_ids)]), np.cumsum([0, *map(len, b_ids)]), links,
                     np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last, int(a_last.sum()))

    @property
    def link_ends(self) -> np.ndarray:
        return self.links.starts[self.a_ends]

    @property
    def group_ends(self) -> np.ndarray:
        return np.searchsorted(self.a_groups, np.arange(self.n_groups + 1))[:-1].searchsorted(self.a_ends)

    def shared_counts(self) -> np.ndarray:
        """Per text the number of links of tokens in one group: the row sums of ``G_A G_B^T``."""
        in_group = np.diff(np.searchsorted(self.b_groups, np.arange(self.n_groups + 1)))
        return np.diff(np.append(0, np.cumsum(in_group[self.a_groups]))[self.a_ends])

    def shared_links(self) -> Iterator[tuple[int, Rows]]:
        """``G_A G_B^T`` in blocks of rows of about ``LINKS_AT_ONCE`` entries, each with its first row."""
        tokens, _ = memberships(self.a_groups, self.n_groups)
        _, groups = memberships(self.b_groups, self.n_groups)
        sizes = np.cumsum(np.diff(groups.starts)[self.a_groups])
        first = 0
        while first < len(self.a):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + LINKS_AT_ONCE, "right")))
            yield first, row_product(tokens.part(first, last), groups)
            first = last

    def written_groups(self, pair: Pair) -> list[str]:
        """Per text its groups: ids of A, ``|``, ids of B, with ``;`` between groups."""
        last_a = np.append(self.a_groups[1:] != self.a_groups[:-1], True)[:len(self.a)]
        last_b = np.append(self.b_groups[1:] != self.b_groups[:-1], True)[:len(self.b)]
        names = np.zeros(len(self.a) + len(self.b), np.int64)
        names[np.arange(len(self.a)) + np.searchsorted(self.b_groups, self.a_groups)] = self.a + last_a * pair.n_a
        names[np.arange(len(self.b)) + np.searchsorted(self.a_groups, self.b_groups, "right")] = \
            2 * pair.n_a + self.b + last_b * pair.n_b
        texts = list(map(pair.written.__getitem__, names.tolist()))
        return ["".join(texts[i:j])[:-1] for i, j in pairwise((self.a_ends + self.b_ends).tolist())]


def blocks(pair: Pair, texts: list[str | None]) -> Iterator[tuple[int, int, Block]]:
    """Alignments of neighbouring texts, about ``BLOCK_BYTES`` or one text at a time."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= BLOCK_BYTES or k + 1 == len(texts):
            yield first, k + 1, Block.of(pair, *pair.encode(texts[first:k + 1]))
            first, held = k + 1, 0


# -- links --------------------------------------------------------------------

def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``LINKS``: one row per overlap link and per link of tokens in one group (kinds overlap, group), with the tokens'
    positions in their text."""
    names = [c.split()[0] for c in LINKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a_path, b_path)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for first, last, block in blocks(pair, texts):
                for kind, begin, rows in (("overlap", 0, block.links), *(("group", k, r) for k, r in block.shared_links())):
                    a = rows.of_entries + begin
                    text = np.searchsorted(block.a_ends, a, "right") - 1
                    shared = rows.values if kind == "overlap" else None
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + t] for t in text.tolist()], pa.int64()), pa.array([kind] * len(a), pa.string()),
                         pa.array(a - block.a_ends[text]), pa.array(rows.at - block.b_ends[text]),
                         pa.array(block.a[a].astype(np.int32)), pa.array(block.b[rows.at].astype(np.int32)),
                         pa.nulls(len(a), pa.int64()) if shared is None else pa.array(shared)], names=names)

    return only(docs, doc_id="long", text="string").mapInArrow(run, LINKS)


class Gathered:
    """What a batch has found: measures per document, and its documents x pairs."""

    def __init__(self, pair: Pair):
        self.pair, self.rows, self.keys, self.counts, self.sizes, self.bytes = pair, [], [], [], [], 0

    def add(self, ids: list[int | None], block: Block) -> None:
        n = len(ids)
        keys = block.a[block.links.of_entries] * self.pair.n_b + block.b[block.links.at]
        ends = block.link_ends
        texts = block.written_groups(self.pair)
        n_a, n_b, n_groups = (np.diff(x).tolist() for x in (block.a_ends, block.b_ends, block.group_ends))
        self.rows += zip(ids, n_a, n_b, n_groups, np.diff(ends).tolist(), block.shared_counts().tolist(),
                         [sha256(t.encode()).hexdigest() if t else "" for t in texts], strict=True)
        most = self.pair.n_a * self.pair.n_b
        found, times = np.unique(np.repeat(np.arange(n), np.diff(ends)) * most + keys, return_counts=True)
        self.keys.append(found % most)
        self.counts.append(times)
        self.sizes += np.bincount(found // most, minlength=n).tolist()

    def out(self, number: int) -> Iterator[pa.RecordBatch]:
        keys, times = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.keys, self.counts))
        pairs, at = np.unique(keys, return_inverse=True)
        ends = np.cumsum([0, *self.sizes]).astype(np.int32)
        steps = np.diff(at, prepend=0)
        steps[ends[:-1][np.array(self.sizes) > 0]] = at[ends[:-1][np.array(self.sizes) > 0]]
        schema = pa.schema([("batch", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in (
            "n_a", "n_b", "n_groups", "n_links", "n_shared")), ("groups_sha256", pa.string()),
            ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pair", pa.int64()), ("links", pa.int64())])
        none = lambda n: [pa.nulls(n, f.type) for f in schema]
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), schema.types[1:8], strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (steps, times)]
        n = len(self.rows)
        yield from pa.Table.from_arrays([pa.array([number] * n, pa.int64()), *columns, *lists, *none(n)[10:]],
                                        schema=schema).to_batches(500)
        totals = np.bincount(at, times, len(pairs)).astype(np.int64)
        for first in range(0, len(pairs), 100_000):
            part = slice(first, first + 100_000)
            m = len(pairs[part])
            yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), *none(m)[1:10], pa.array(pairs[part]),
                                              pa.array(totals[part])], schema=schema)


def aligned(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``FOUND``: rows of documents, with the places of their pairs among the batch's (as differences) and how often they
    have each; and rows of the batch's pairs with its number of links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, pair = TaskContext.get().partitionId() << 33, tokenizers(a_path, b_path)
        held = Gathered(pair)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for first, last, block in blocks(pair, texts):
                held.add(ids[first:last], block)
                held.bytes += sum(len(t or "") for t in texts[first:last])
                if held.bytes >= batch_bytes:
                    yield from held.out(number)
                    held, number = Gathered(pair), number + 1
        if held.rows:
            yield from held.out(number)

    return only(docs, doc_id="long", text="string").mapInArrow(run, FOUND)


def counted(docs: DataFrame, a_path: str, b_path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``COUNTED`` per document: its measures; ``count_sum``, over its links the number of links of their id pair in the
    corpus; ``n_best``, its links whose pair is the most frequent of its B id."""
    found = write_and_read(aligned(docs, a_path, b_path, batch_bytes), "aligned")
    n_b = tokenizers(a_path, b_path).n_b
    pairs = found.filter("pair IS NOT NULL").select("batch", "pair", "links")
    counts = write_and_read(pairs.groupBy("pair").agg(F.sum("links").alias("count")), "counts")
    # one row per id of B: bounded by its vocabulary
    best = counts.groupBy((F.col("pair") % n_b).alias("b_id")).agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(best), F.col("pair") % n_b == F.col("b_id")).select(
        "pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    totals = pairs.join(known, "pair").select(F.col("batch").alias("of_batch"), "pair", "count", "best")
    rows = found.filter("pair IS NULL").drop("pair", "links")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        weights = np.stack([right.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best")])
        steps, times = (left.column(c).combine_chunks() for c in ("steps", "times"))
        starts = np.append(0, np.cumsum(steps.value_lengths().to_numpy()))
        at = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
        sizes = np.diff(starts)
        begins = np.append(0, at)[starts[:-1]]  # the differences start anew with every document
        of_pairs = Rows(starts, at - np.repeat(begins, sizes), times.flatten().to_numpy().astype(np.int64), weights.shape[1])
        sums = [np.zeros(len(left), np.int64) for _ in weights]
        for k, w in enumerate(weights):
            column = Rows(np.arange(len(w) + 1), np.zeros(len(w), np.int64), w, 1)
            product = row_product(of_pairs, column)
            sums[k][product.of_entries] = product.values
        kept = left.drop_columns(["batch", "steps", "times"])
        return kept.append_column("n_best", pa.array(sums[1])).append_column("count_sum", pa.array(sums[0]))

    return rows.groupBy("batch").cogroup(totals.groupBy("of_batch")).applyInArrow(run, COUNTED)
