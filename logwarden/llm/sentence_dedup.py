"""Substring dedup by sliding sentence spans.

1. A text is cut into sentences: after ``.``, ``!`` or ``?`` (or another script's full stop) before white space, after
   full stops of scripts without spaces, and at new lines. A sentence of more than ``MAX_WORDS`` words is cut after every
   word whose hash is less than those of its ``NEIGHBOURS`` to either side, and after ``MAX_WORDS`` words without one. So
   the cuts inside a repeated passage meet, wherever in a sentence it begins. In scripts without spaces two characters
   count as a word, and the last three characters are hashed.
2. Every run of ``run`` consecutive sentences with ``min_words`` words or more is hashed (A-Z lower-cased, white space
   as one space, 64 bits).
3. One aggregation counts every hash and finds its first document; a join brings the repeated ones back. The run that
   comes first, by doc_id and place, stays. Sentences covered by any other repeated run go.
4. The numbers of lost sentences go back to their texts; what is left keeps its characters as they were.

A hash that is common to a third of all documents is combined in the map tasks first, and the join's large side is
split by adaptive execution. With 10**12 runs one run in 10**7 would be lost to a hash shared by chance.

Defined results: a null text stays null, an empty one empty, without sentences; fewer sentences than ``run`` are never
removed; rows with one doc_id are one document, whose rows do not remove each other's first runs; rows without doc_id
come last and are one document; an empty table gives no rows; extra columns are ignored by ``spans`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.columns import repeatable

RUN = 3
MAX_WORDS = 16
NEIGHBOURS = 3
MIN_WORDS = 10
LAST = (1 << 63) - 1
RUNS = "_row long, place long, pos int, h long, first boolean"
KEPT = "text string, n_sentences int, n_removed int"

SPACE = r" \t\n\x0b\f\r"
#: Scripts without spaces between words: Thai to Myanmar, Khmer, Chinese and Japanese.
SOLID = "฀-႟ក-៿⺀-鿿豈-﫿！-／：-＠｟-ﾟ\U00020000-\U0003ffff"
SOLID_ONE = re.compile(f"[{SOLID}]")
#: Where a sentence ends; white space belongs to the sentence before.
END = re.compile(rf"[.!?։؟۔।॥።፧᠃…‼⁇-⁉][{SPACE}]+|[。！．？｡།༎។៕]+[」』”’）]*[{SPACE}]*|\n[{SPACE}]*")
END_ASCII = re.compile(rb"[.!?]\s+|\n\s*")
TOKEN = re.compile(rf"[{SPACE}]*(?:([{SOLID}])|[^{SPACE}{SOLID}]+)[{SPACE}]*")
WORD = re.compile(rb"\s*\S+\s*")

#: Up to MAX_WORDS words: all but the last end in no full stop and at no line's end. White space belongs to the word before.
COUNTED = re.compile(rb"\s*(?:\S*[^\s.!?][^\S\n]+){0,%d}\S+\s*" % (MAX_WORDS - 1))

Cut = Callable[[bytes], list[bytes]]


def counted_sentences(text: bytes) -> list[bytes]:
    """Sentences as the SQL of ``op5_sentence_dedup`` cuts them: long ones every MAX_WORDS words from their start."""
    return COUNTED.findall(text)


def half_words(sentence: bytes) -> int:
    """Twice the number of words; a character of a script without spaces is half a word."""
    if not sentence.isascii() and SOLID_ONE.search(text := sentence.decode()):
        solid = len(SOLID_ONE.findall(text))
        return solid + 2 * len(SOLID_ONE.sub(" ", text).encode().split())
    return 2 * len(sentence.split())


def pieces(sentence: bytes) -> list[bytes]:
    """A sentence, cut after least words if it is too long. No piece is under four words, none much over MAX_WORDS."""
    if half_words(sentence) <= 2 * MAX_WORDS:
        return [sentence]
    if sentence.isascii() or not SOLID_ONE.search(sentence.decode()):
        parts, keys = WORD.findall(sentence), sentence.lower().split()
        around = [NEIGHBOURS] * len(parts)
    else:
        parts, keys, around, before = [], [], [], ("", "")
        for token in TOKEN.finditer(sentence.decode()):
            solid = token[1] or ""
            parts.append(token[0].encode())
            keys.append("".join((*before, solid)).encode() if solid else parts[-1].lower().strip())
            around.append(2 * NEIGHBOURS + 1 if solid else NEIGHBOURS)
            before = (before[1], solid)
    hashes = [*map(zlib.crc32, keys), 1 << 32]
    out, last, n = [], -1, len(parts)
    for k, w in enumerate(around):
        size, h = k - last, hashes[k]
        if size > w and k + w + 1 < n and (size >= (MAX_WORDS if w == NEIGHBOURS else 2 * MAX_WORDS) or (
                h < hashes[k - 1] and h <= hashes[k + 1] and h < min(hashes[k - w:k]) and h <= min(hashes[k + 1:k + w + 1]))):
            out.append(b"".join(parts[last + 1:k + 1]))
            last = k
    return [*out, b"".join(parts[last + 1:])]


def sentences(text: bytes) -> list[bytes]:
    """The sentences; joined they are the text (a text of white space has none)."""
    whole = text if (plain := text.isascii()) else text.decode()
    begin, out = 0, []
    for end in [m.end() for m in (END_ASCII if plain else END).finditer(whole)] + [len(whole)]:
        part = whole[begin:end] if plain else whole[begin:end].encode()
        if part.strip():
            out += pieces(part)
            begin = end
    return out


def run_hashes(parts: list[bytes], run: int, min_words: int, solid: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run that is long enough; ``solid``: scripts without spaces count by characters."""
    words = [p.lower().split() for p in parts]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64)
    counts = np.array([half_words(p) if solid else 2 * len(w) for p, w in zip(parts, words, strict=True)])
    n = len(parts) - run + 1
    total, mixed = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for k in range(run):
        total += counts[k:k + n]
        mixed = (mixed ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    at = np.flatnonzero(total >= 2 * min_words)
    return at, mixed[at].view(np.int64)


def runs(rows: DataFrame, run: int, min_words: int, into: Cut) -> DataFrame:
    """Rows (_row, place, text) to one row per run; ``first``: the first of its hash in the row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                out = []
                part = batch.slice(begin, 500)
                for row, place, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    cut = into((text or "").encode())
                    if len(cut) >= run:
                        at, h = run_hashes(cut, run, min_words, into is not counted_sentences)
                        first = np.zeros(len(h), bool)
                        first[np.unique(h, return_index=True)[1]] = True
                        out.append((np.full(len(h), row), np.full(len(h), place), at.astype(np.int32), h, first))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                     names=[c.split()[0] for c in RUNS.split(", ")])

    return rows.mapInArrow(work, RUNS)


def lost_runs(rows: DataFrame, run: int, min_words: int, into: Cut) -> DataFrame:
    """``_row`` and the places of its runs that repeat an earlier one."""
    found = runs(rows, run, min_words, into)
    repeated = found.groupBy("h").agg(F.count("*").alias("n"), F.min("place").alias("lead")).filter("n > 1")
    later = found.join(repeated, "h").filter(~((F.col("place") == F.col("lead")) & F.col("first")))
    return later.groupBy("_row").agg(F.collect_list("pos").alias("lost"))  # within one document


def without_runs(text: str | None, lost: list[int] | None, run: int, into: Cut) -> tuple[str | None, int, int]:
    parts = into((text or "").encode())
    gone = {k for at in lost or () for k in range(at, at + run)}
    if not gone:
        return text, len(parts), 0
    return b"".join(p for k, p in enumerate(parts) if k not in gone).decode(), len(parts), len(gone)


def cleaned(docs: DataFrame, run: int, min_words: int, into: Cut) -> DataFrame:
    """``doc`` (the whole row), text, n_sentences, n_removed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                done = [without_runs(t, g, run, into) for t, g in zip(part.column("text").to_pylist(),
                                                                part.column("lost").to_pylist(), strict=True)]
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                     pa.array(columns[2], pa.int32())], names=["rest", "text", "n_sentences", "n_removed"])

    rest = [c for c in docs.columns if c != "text"]
    docs = repeatable(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"),
                       F.coalesce(F.col("`doc_id`").cast("long"), F.lit(LAST)).alias("place"),
                       F.col("`text`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    lost = lost_runs(rows.select("_row", "place", "text"), run, min_words, into)
    joined = rows.join(lost, "_row", "left").select("rest", "text", "lost")
    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(work, f"rest {kind}, {KEPT}")


def spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, into: Cut = sentences) -> DataFrame:
    """Per document row: doc_id, text (what is left), n_sentences, n_removed."""
    return cleaned(docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")), run, min_words, into) \
        .select("rest.doc_id", "text", "n_sentences", "n_removed")


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, into: Cut = sentences) -> DataFrame:
    """``docs`` with repeated sentences cut out of ``text``; all columns kept."""
    return cleaned(docs, run, min_words, into).select(*(
        F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
