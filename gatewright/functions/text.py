"""String helpers.  All but `fnv1a64_pairs` are built-in expressions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class used by trimming: wider than Java's \s.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_BREAK = r"\r?\n"


def strip_space(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A{SPACE}+|{SPACE}+\z", "")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 code units (characters outside the BMP count twice)."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def lines_of(content: Column) -> Column:
    """Array of lines; trailing empty lines are kept."""
    return F.split(content, LINE_BREAK, -1)


def says(value: Column, lowered: Column, pattern: str, literals: list[str]) -> Column:
    """``value`` matches ``pattern``, which ignores the case of ASCII letters and is tried only where the text in lower case holds a literal."""
    held = reduce(Column.__or__, [lowered.contains(literal) for literal in literals])
    return held & value.rlike(pattern)


def newline_count(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))


def slugify(value: Column) -> Column:
    dashed = F.regexp_replace(value, "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(dashed, r"\A-|-\z", ""))


def char_counts(token: Column) -> Column:
    """How often each distinct character of a text without line breaks occurs: the runs of its sorted characters."""
    ordered = F.array_join(F.array_sort(F.split(token, "")), "")
    return F.transform(F.regexp_extract_all(ordered, F.lit(r"(.)\1*"), F.lit(0)), F.length)


def entropy_of(counts: Column) -> Column:
    """Bits per character, from the counts of the characters; no explode and no Python."""

    def bits(size: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - (n / size) * F.log2(n / size))

    return bind(F.aggregate(counts, F.lit(0), lambda acc, n: acc + n), bits)


def shannon_entropy(token: Column) -> Column:
    """Bits per character of a token."""
    return bind(char_counts(token), entropy_of)


def strip_urls(value: Column) -> Column:
    return F.regexp_replace(value, r"(?i)(?<!\w)https?://[^\s)>\]}\"'`]+", " ")


def assignment_value(token: Column) -> Column:
    """``NAME=value`` -> value; null when the left side is not a variable name.

    The left side counts as a name when it has no digits or has an underscore.
    """
    bare = F.regexp_replace(token, r"=+\z", "")
    found = F.regexp_extract(
        bare, r"\A(?:[A-Za-z_]+|(?=[A-Za-z0-9]*_)[A-Za-z_][A-Za-z0-9_]*)=(.+)\z", 1
    )
    return F.nullif(found, F.lit(""))


_BLOCK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable holds a value, not an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_totals(counts: Column) -> Column:
    """Inclusive running sums of an array<int>: block sums first, then at most one block per element."""
    starts = F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / _BLOCK).cast("int"))
    sums = F.transform(starts, lambda k: _total(F.slice(counts, k * _BLOCK + 1, _BLOCK)))

    def place(before: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            first = i - i % _BLOCK
            return F.get(before, (first / _BLOCK).cast("int")) + _total(F.slice(counts, first + 1, i % _BLOCK + 1))

        return F.transform(counts, at)

    before = bind(sums, lambda s: F.transform(s, lambda _, k: _total(F.slice(s, F.lit(1), k))))
    return F.when(F.size(counts) > 0, bind(before, place)).otherwise(counts)


def match_lines(content: Column, pattern: str) -> Column:
    """array<struct<match, line>> of all non-overlapping matches with 1-based lines.

    Splitting by the same pattern yields the text between the matches, so a match's line is one more than the line
    breaks in the pieces and matches before it.
    """
    pieces = F.transform(F.split(content, pattern, -1), newline_count)
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))

    def placed(matches: Column) -> Column:
        own = F.transform(matches, newline_count)
        # Line breaks since the start of the match before: its own, and those of the piece between.
        steps = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(matches)),
            F.concat(F.array(F.lit(0)), F.slice(own, F.lit(1), F.greatest(F.size(matches) - 1, F.lit(0)))),
            lambda piece, inside: F.coalesce(piece, F.lit(0)) + F.coalesce(inside, F.lit(0)),
        )
        lines = bind(F.slice(steps, F.lit(1), F.size(matches)), running_totals)
        return F.zip_with(matches, lines, lambda m, n: F.struct(m.alias("match"), (n + 1).alias("line")))

    return bind(found, placed)


def first_match(content: Column, pattern: str) -> Column:
    """struct<match, line> of the first match, null without one."""
    at = F.regexp_instr(content, F.lit(pattern))
    line = newline_count(F.substr(content, F.lit(1), at - 1)) + 1
    match = F.regexp_extract(content, pattern, 0)
    return F.when(at > 0, F.struct(match.alias("match"), line.alias("line")))


# FNV-1a, 32 bit: offset basis and prime (fixed values of the published hash).
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
_LOW32 = 4294967295


def _fnv_step(h: Column, unit: Column) -> Column:
    return (h.bitwiseXOR(unit) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_LOW32))


def fnv1a64_pair(value: Column) -> Column:
    """Two 32-bit FNV-1a hashes (suffixes NUL-a and NUL-b) as 16 hex digits.

    Hashes UTF-16 code units.  The shared prefix is folded once; only the two
    suffix units differ.
    """
    encoded = F.encode(value, "UTF-16BE")
    count = (F.octet_length(encoded) / 2).cast("int")
    # Without characters outside the BMP a character is one unit, and ascii() is its code.
    plain = F.transform(F.split(value, ""), lambda ch: F.ascii(ch).cast("bigint"))
    wide = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.conv(F.hex(F.substring(encoded, i * 2 - 1, F.lit(2))), 16, 10).cast("bigint"),
    )
    none = F.array().cast("array<bigint>")
    units = F.when(value == "", none).when(value.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(plain)
    prefix = F.aggregate(units, F.lit(FNV_OFFSET).cast("bigint"), _fnv_step)

    def finish(acc: Column) -> Column:
        nul = _fnv_step(acc, F.lit(0).cast("bigint"))
        half = [
            F.lpad(F.lower(F.hex(_fnv_step(nul, F.lit(ord(c)).cast("bigint")))), 8, "0") for c in "ab"
        ]
        return F.concat(*half)

    return F.element_at(F.transform(F.array(prefix), finish), 1)


def _pairs_of_batches():
    """The function over batches; it is shipped as it stands, so workers need nothing of this package."""

    def pairs(texts: pa.Array) -> pa.Array:
        texts, n = texts.cast(pa.large_string()), len(texts)
        places = np.frombuffer(texts.buffers()[1] or b"", np.int64)[texts.offset : texts.offset + n + 1]
        size = int(places[-1]) if n else 0
        units = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:size]
        if n and (units[places[0] :] > 127).any():  # a byte is no longer a unit
            wide = [(text or "").encode("utf-16-le") for text in texts.to_pylist()]
            places = np.concatenate([[0], np.cumsum([len(text) // 2 for text in wide])]).astype(np.int64)
            units = np.frombuffer(b"".join(wide), "<u2")
        lengths = places[1:] - places[:-1]
        order = np.argsort(-lengths, kind="stable")  # the longest first: those that still have a unit are in front
        starts = places[:-1][order]
        more = n - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
        prime, folded = np.uint32(FNV_PRIME), np.full(n, FNV_OFFSET, np.uint32)
        for i, k in enumerate(more.tolist()):
            folded[:k] = (folded[:k] ^ units[starts[:k] + i]) * prime
        nul = np.empty(n, np.uint32)
        nul[order] = folded * prime
        halves = np.empty((n, 2), ">u4")
        for column, letter in enumerate(b"ab"):
            halves[:, column] = (nul ^ np.uint32(letter)) * prime
        ends = np.arange(0, 16 * n + 1, 16, dtype=np.int64)
        digits = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(halves.tobytes().hex().encode()))
        return pa.compute.if_else(texts.is_valid(), digits, None).cast(pa.string())

    return pairs


def fnv1a64_pairs(value: Column) -> Column:
    """`fnv1a64_pair` for whole tables: one step takes the next unit of every text of a batch.

    It always computes; where a text is rarely needed, `fnv1a64_pair` under a condition is the cheaper one.
    """
    return F.arrow_udf(_pairs_of_batches(), "string")(value)
