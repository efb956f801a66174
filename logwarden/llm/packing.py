"""Best-fit packing of token sequences with a fixed number of open bins.

1. Documents are tokenised where they lie: ids, then the end id. Only documents longer than ``size`` are cut, into
   pieces of ``size`` tokens. A full piece is a sequence of its own; it needs no packing.
2. Pieces, as rows of a few numbers, are dealt by hash over ``pieces / ITEMS_PER_TASK`` partitions and arrive there by
   falling length (equal ones by that hash), which gives every rerun the same order and leaves the short ones to fill
   the gaps. A full piece fills a sequence of its own.
3. Each partition packs online: a piece goes into the open bin with the least free space that holds it. Bins are keyed
   by their free space; one bitset of ``size + 1`` bits tells which spaces exist, so the best fit is the lowest set bit
   at or above the length. If more than ``OPEN_BINS`` bins are open, the fullest closes.

Python workers keep a bounded table of word -> ids, which is exact: the tokenizer cuts text into words before merging.
Texts with characters whose case or space rules need context go through the tokenizer whole.

Defined results: a null or empty text is one piece with the end id only; repeated documents are packed each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import only

SIZE = 2048
END_ID = 0
OPEN_BINS = 65_536
ITEMS_PER_TASK = 100_000
CACHE_WORDS = 400_000
CHUNK_CHARS = 1_000_000
PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
PLACED = PIECES + ", sequence_id long, offset long"

#: Bytes of texts in which white space always parts words and no character needs its neighbours to be normalised:
#: printable ASCII, tab, new line, and the precomposed letters of U+00C0 to U+00FF.
PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True
#: ASCII marks: neither letters, digits nor white space.
MARK = np.array([chr(b).isprintable() and not chr(b).isalnum() and b != 0x20 and b < 0x80 for b in range(256)])


class WordTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer cuts at white space before it merges, so the ids of a plain text are those of its words, which a
    bounded table remembers. Other texts, and those that hold the string of a special token, are encoded whole.
    """

    def __init__(self, path: str, most_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_words = most_words
        self.forget()
        # a character that is one token and stands in no plain text
        self.mark, self.mark_id = next((c, ids[0]) for c in map(chr, range(0x2010, 0x2123))
                                       if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1)

    def forget(self) -> None:
        """An empty table: a word's number in ``known``; word i has the ids[ends[i - 1]:ends[i]], the empty word (0) none."""
        self.known, self.ids, self.ends = {"": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add many plain words at once: they are encoded as one text, with the mark between words."""
        ids = np.asarray(self.tokenizer.encode_batch_fast(
            [f" {self.mark} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(ids == self.mark_id)
        ends = np.append(marks, len(ids)) - np.arange(len(words))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, np.delete(ids, marks)])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, texts: list[str]) -> list[str | None]:
        """The plain texts with white space between their words; None for those that must be encoded whole.

        Commas and full stops become words of their own, so that a word is remembered once, unless they stand next to
        another mark, with which the tokenizer would take them together.
        """
        raw = [text.encode() for text in texts]
        whole = b"\n".join([*raw, b""])  # a new line is plain and no mark
        data = np.frombuffer(whole, np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        marks, stops = MARK[data], (data == 44) | (data == 46)
        beside = np.append(marks[1:] & marks[:-1] & (stops[1:] | stops[:-1]), False)
        odd = np.add.reduceat(~PLAIN[data], starts, dtype=np.int64) > 0
        met = np.add.reduceat(beside, starts, dtype=np.int64) > 0
        for s in self.specials:
            if s.encode() in whole:
                odd |= [s in text for text in texts]
        for s in "×÷":
            if s.encode() in whole:
                met |= [s in text for text in texts]
        return [None if o else text if m else text.replace(",", " , ").replace(".", " . ")
                for text, o, m in zip(texts, odd.tolist(), met.tolist(), strict=True)]

    def of_words(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts, by their words."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(self.known) + len(new) > self.most_words:
            self.forget()
            found = np.array([-1 if w else 0 for w in words], np.int64)
            new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.known) + np.arange(len(new))
            self.learn([words[i] for i in new.tolist()])
        place = found[coded.indices.to_numpy()]
        begins = np.append(0, self.ends[:-1])[place]
        ends = np.append(0, np.cumsum(self.ends[place] - begins))
        at = np.arange(ends[-1]) + np.repeat(begins - ends[:-1], np.diff(ends))
        data, cuts = self.ids[at].tobytes(), (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        spaced = self.spaced(texts)
        plain = iter(self.of_words([s for s in spaced if s is not None]))
        return [self.encode([text])[0] if s is None else next(plain) for text, s in zip(texts, spaced, strict=True)]


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def chunks(texts: list[str | None], most_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most_chars`` characters, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most_chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def cut(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """Start, length and checksum of every piece."""
    return [(at // 4, len(part) // 4, zlib.crc32(part))
            for at in range(0, len(ids), 4 * size) if (part := ids[at:at + 4 * size])]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """One row per piece. ``copy`` tells repeated rows of a document apart."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(tokenizer_path)
        for batch in batches:
            docs, copies, texts = (c.to_pylist() for c in batch.columns)
            for first, last in chunks(texts, CHUNK_CHARS):
                ids = ids_of([text or "" for text in texts[first:last]])
                rows = [(doc, copy, k, *part) for doc, copy, doc_ids in zip(
                    docs[first:last], copies[first:last], ids, strict=True)
                    for k, part in enumerate(cut(doc_ids + end, size))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    rows = only(docs, doc_id="long", text="string").select(
        "doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(run, PIECES)


class Bins:
    """Open bins keyed by free space; a bitset marks the spaces that some bin has."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.spaces = size, most, 0, 0
        self.by_space: dict[int, list[int]] = {}
        self.next = 0

    def take(self, space: int) -> int:
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, number: int, space: int) -> None:
        if not space:
            return
        self.by_space.setdefault(space, []).append(number)
        self.spaces |= 1 << space
        self.open += 1
        if self.open > self.most:
            self.take((self.spaces & -self.spaces).bit_length() - 1)

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self.take(space)
        else:
            number, space = self.next, self.size
            self.next += 1
        self.put(number, space - length)
        return number, self.size - space


def pack(parts: DataFrame, n_pieces: int, size: int = SIZE, open_bins: int = OPEN_BINS,
         items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``parts`` with sequence_id and offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, Bins(size, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    tasks = max(1, -(-n_pieces // items_per_task))
    order = F.xxhash64("doc_id", "copy", "piece")
    return parts.repartition(tasks, order).sortWithinPartitions(F.desc("length"), order, "doc_id", "copy", "piece") \
        .mapInArrow(run, PLACED)


def expected_pieces(docs: DataFrame, size: int = SIZE) -> int:
    """About how many pieces there will be, from the number of documents and their bytes (three a token)."""
    return docs.agg(F.count("*") + F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (3 * size)).first()[0].__ceil__()


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Tokenise, cut and pack: one row per piece (see ``PLACED``)."""
    docs = only(docs, doc_id="long", text="string")
    return pack(pieces(docs, tokenizer_path, size), expected_pieces(docs, size), size)
