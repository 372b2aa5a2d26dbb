"""Text column functions (JVM-side expressions only).

Python's ``casefold`` and Unicode ``\\s`` differ from Spark's ``lower`` and
Java's ASCII ``\\s``; both are rebuilt here from Python's own Unicode tables so
that keys computed on the cluster equal the keys of the original pipeline.
"""
from __future__ import annotations

import html
import json
import sys
import zlib
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cp(ch: str) -> str:
    return "\\x{%04X}" % ord(ch)


@lru_cache(maxsize=1)
def whitespace_class() -> str:
    """Regex class equal to Python's ``str.isspace`` set, usable in Java and RE2
    (explicit code points; used for the DuckDB oracle and inside other classes)."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    return "[" + "".join(_cp(c) for c in chars) + "]"


# The same set for Java regexes as one property plus four code points, which
# compiles to a short predicate instead of a chain of single characters
# (checked equal to str.isspace over every code point in the tests).
JAVA_WS = r"[\p{javaWhitespace}\x{0085}\x{00A0}\x{2007}\x{202F}]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose casefold differs from their lower-case form.

    Derived by rule from the running Python's Unicode database: single-char
    results go to one ``translate``; multi-char results to guarded replaces.
    """
    single_src, single_dst, multi = [], [], []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        low, fold = ch.lower(), ch.casefold()
        if low == fold or len(low) != 1:
            continue
        if len(fold) == 1:
            single_src.append(low)
            single_dst.append(fold)
        else:
            multi.append((low, fold))
    # de-duplicate keeping first mapping
    seen: set[str] = set()
    src, dst = [], []
    for s, d in zip(single_src, single_dst):
        if s not in seen:
            seen.add(s)
            src.append(s)
            dst.append(d)
    mseen: dict[str, str] = {}
    for s, d in multi:
        mseen.setdefault(s, d)
    return "".join(src), "".join(dst), tuple(mseen.items())


@lru_cache(maxsize=1)
def fold_rare_class() -> str:
    """Regex class of the lower-case characters whose casefold differs from them
    (sharp s apart, which has a cheaper path): texts without any, such as Hangul
    ones, never take the long path."""
    src, _, multi = _fold_tables()
    points = sorted({ord(c) for c in src} | {ord(c) for c, _ in multi if c != "\u00df"})
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(_cp(chr(x)) + ("-" + _cp(chr(y)) if y > x else "") for x, y in runs) + "]"


# Blocks without rare characters: ASCII and Latin-1 but the micro sign, general
# punctuation, kana, Han and Hangul. Few ranges, so a text is scanned fast.
FOLD_COMMON = ((0x00, 0xB4), (0xB6, 0xFF), (0x2000, 0x206F), (0x3000, 0x9FFF), (0xAC00, 0xD7A3))


@lru_cache(maxsize=1)
def common_text() -> str:
    """Regex of texts within :data:`FOLD_COMMON`; possessive, so that Java scans
    runs in loops and never goes back."""
    return r"\A(?:[\x00-\x7F]++|[" + "".join(f"{_cp(chr(a))}-{_cp(chr(b))}" for a, b in FOLD_COMMON) + r"]++)*+\z"


def fold(col: Column) -> Column:
    """Python ``str.casefold`` as a Spark expression.

    Common text (ASCII and Latin-1 letters) takes ``lower`` plus one plain
    substring replace for sharp s; the full translate / multi-character path
    runs only for rows holding a rarer character, which only rows with a
    character outside the common blocks are searched for.
    """
    src, dst, multi = _fold_tables()
    low = F.lower(col)
    full = F.translate(low, src, dst)
    for s, d in multi:
        full = F.replace(full, F.lit(s), F.lit(d))
    return F.when(~low.rlike(common_text()) & low.rlike(fold_rare_class()), full).otherwise(F.replace(low, F.lit("\u00df"), F.lit("ss")))


def collapse_ws(col: Column) -> Column:
    """``re.sub(r"\\s+", " ", v).strip()`` with Python's Unicode whitespace."""
    return F.trim(F.regexp_replace(col, JAVA_WS + "+", " "))


def fold_text(col: Column) -> Column:
    """Casefold, collapse whitespace, trim; null reads as ''."""
    return collapse_ws(fold(F.coalesce(col, F.lit(""))))


MATCH_KEY_DROP = "[^0-9a-z\\x{AC00}-\\x{D7A3}]+"


def match_key(col: Column) -> Column:
    """Casefold then keep only ASCII digits, a-z and Hangul syllables."""
    return F.regexp_replace(fold(F.coalesce(col, F.lit(""))), MATCH_KEY_DROP, "")


# The most common references.
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
)
# What the standard calls a character reference, closed or not.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REFERENCE_BUCKETS = 512
REPLACEMENT = "\uFFFD"


@lru_cache(maxsize=1)
def _named_references() -> str:
    """The standard's named references as JSON: a hash table of small maps, so
    that one lookup compares a few names. Taken from the running Python."""
    buckets: list[dict[str, str]] = [{} for _ in range(REFERENCE_BUCKETS)]
    for name, value in html5.items():
        buckets[zlib.crc32(name.encode()) % REFERENCE_BUCKETS][name] = value
    return json.dumps(buckets)


@lru_cache(maxsize=1)
def _odd_numbers() -> str:
    """Numeric references that do not stand for their own code point, below 160."""
    return json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)})


def _numbered(body: Column) -> Column:
    """The character of ``#123`` or ``#x7B`` (with or without ``;``)."""
    digits = F.rtrim(F.regexp_replace(body, "^#[xX]?0*", ""), F.lit(";"))
    hexed = body.rlike("^#[xX]")
    odd = F.from_json(F.lit(_odd_numbers()), "map<string,string>")

    def value(digits: Column) -> Column:
        small = F.length(digits) <= 8      # longer ones are beyond Unicode anyway
        return F.when(~small, F.lit(1 << 40)).when(digits == "", F.lit(0)).when(hexed, F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))

    def character(number: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        none = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return (F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit(REPLACEMENT))
                .when(number < 160, F.coalesce(odd[number.cast("string")], char)).when(none, F.lit("")).otherwise(char))

    return bound(bound(digits, value), character)


def bound(col: Column, use) -> Column:
    """``use(col)`` with ``col`` bound by a lambda, so that its expression stands
    in the plan, and is evaluated, once."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def _referenced(ref: Column) -> Column:
    """What one reference stands for. An unknown name gives way to its longest
    known beginning; a name without one stays as it is."""
    table = F.from_json(F.lit(_named_references()), "array<map<string,string>>")
    body = F.substring(ref, F.lit(2), F.length(ref))

    def known(name: Column) -> Column:
        return F.get(table, (F.crc32(name.cast("binary")) % REFERENCE_BUCKETS).cast("int"))[name]

    def beginning(n: Column) -> Column:
        value = known(F.substring(body, F.lit(1), n))
        return F.when(value.isNotNull(), F.concat(value, F.substring(body, n + 1, F.length(body))))

    sizes = F.when(F.length(body) > 2, F.sequence(F.length(body) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    partly = F.get(F.array_compact(F.transform(sizes, beginning)), F.lit(0))
    return F.when(body.startswith("#"), _numbered(body)).otherwise(F.coalesce(known(body), partly, ref))


def html_unescape(col: Column) -> Column:
    """HTML character references (the standard's whole table, numeric ones, names
    without ``;``) as characters. A text is cut at its references, which are
    looked up and joined with the pieces between; texts without ``&`` are not cut."""
    def decoded(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referenced)
        between = F.split(text, REFERENCE, -1)
        joined = F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)

    return bound(col, decoded)


def html_unescape_common(col: Column) -> Column:
    """The common references only: a few nodes, for expressions that decode many
    pieces of markup (the whole table is a literal of 40 kB in the plan)."""
    out = col
    for ent, ch in HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def clean_text(col: Column, whole_table: bool = False) -> Column:
    """HTML-unescape, collapse whitespace, trim; ``whole_table``: every
    reference of the standard, else the common ones."""
    decode = html_unescape if whole_table else html_unescape_common
    return collapse_ws(decode(F.coalesce(col, F.lit(""))))


def strip_title_markers(col: Column) -> Column:
    """Collapse whitespace, drop leading ``>``, fullwidth bar, bar, middle dot, spaces."""
    ws = JAVA_WS
    collapsed = F.regexp_replace(col, ws + "+", " ")
    return F.trim(F.regexp_replace(collapsed, "^(?:[>\\x{FF5C}|\\x{00B7}]|" + ws + ")+", ""))
