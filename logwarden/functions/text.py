"""Column expressions over text: one-pass capture, whitespace, decoding, dates.

All of them are built-in Spark expressions, so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters, so they cannot be part of a valid text. They mark the
# parts of a captured match; see `capture`.
_START, _PART, _ROW = "\ufffe", "\uffff", "\ufdd0"

# Whitespace as the source format's language defines it (also \x1c-\x1f).
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                             0x202F, 0x205F, 0x3000]))


def capture(text: Column, pattern: str, parts: Sequence[str], search: bool = False) -> Column:
    """Several groups of the first match from ONE evaluation of the pattern.

    ``regexp_extract`` runs the whole pattern again for every group. Here the
    line is rewritten once into its wanted parts (``$1``-style templates) and
    the result is a packed string, null when the pattern does not match. Packed
    strings can be chained with ``coalesce``, which stops at the first match.
    Unpack with `unpack`; `unmark` the text first. ``search=True`` matches anywhere, else at the start.
    """
    lead = "^(?s:.*?)" if search else "^"
    whole = f"(?d){lead}(?:{pattern})(?s:.*)$"
    template = _START + _PART.join(parts)
    marked = F.regexp_replace(text, F.lit(whole), F.lit(template))
    return F.get(F.split(marked, _START), F.lit(1))


def unmark(text: Column) -> Column:
    """Replace the noncharacters used as marks; apply once before `capture`."""
    clean = text
    for mark in (_START, _PART, _ROW):
        clean = F.replace(clean, F.lit(mark), F.lit("\ufffd"))
    return clean


def packed(*parts: Column | str) -> Column:
    """A packed value from literal parts (or columns), as `capture` returns it."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]
    return F.concat_ws(_PART, *cols)


def unpack(value: Column) -> Column:
    return F.split(value, _PART)


def explode_match(value: Column) -> Column:
    """Generator that yields the packed value, and no row when it is null.

    A plain ``filter(value.isNotNull())`` would be pushed below the projection
    by the optimizer and evaluate the pattern a second time for every line.
    """
    return F.explode(F.split(value, _ROW))


def part(parts: Column, index: int) -> Column:
    """Part of an unpacked value; null when empty."""
    return F.nullif(F.get(parts, F.lit(index)), F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Trim by the whitespace class above. By characters: a pattern would try every run of white space inside a long text."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS[1:]}")


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(strip(text), f"{WS}+"))


def word_count(text: Column) -> Column:
    """Number of words: the gaps between them, plus one.

    Counting gaps is several times faster than matching words by the negated
    class, which the JVM tests member by member.
    """
    def edge(char: Column) -> Column:
        return F.when(char.rlike(WS), 1).otherwise(0)

    gaps = F.size(F.split(text, f"{WS}+"))
    return F.when(text == "", 0).otherwise(gaps - edge(F.left(text, F.lit(1))) - edge(F.right(text, F.lit(1))))


def tokens(text: Column) -> Column:
    """Lower-cased whitespace words, the tokenizer of the sparse index."""
    return words(F.lower(text))


def contains_any(text: Column, *needles: str) -> Column:
    cond = F.lit(False)
    for needle in needles:
        cond = cond | text.contains(needle)
    return cond


def url_decode_once(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` and bad escapes as they are."""
    escaped = F.regexp_replace(
        F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(escaped), text)).otherwise(text)


def url_decode_twice(text: Column) -> Column:
    once = url_decode_once(text)
    return F.when(text.contains("%"), url_decode_once(once)).otherwise(text)


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def iso_timestamp(text: Column) -> Column:
    """ISO date-time, optionally with a fraction and an offset (none means UTC)."""
    shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,6})\d*)?(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?$"
    packed_ts = capture(text, shape.rstrip("$") + "$", ["$1", "$2", "$3", "$5", "$6"])
    p = unpack(packed_ts)
    return F.concat(
        F.get(p, F.lit(0)), F.lit(" "), F.get(p, F.lit(1)), F.lit("."),
        F.rpad(F.get(p, F.lit(2)), 6, "0"),
        F.coalesce(part(p, 3), F.lit("+00")), F.lit(":"), F.coalesce(part(p, 4), F.lit("00")),
    ).try_cast("timestamp")
