"""String expressions. All are built-in Spark functions, so they stay in codegen.

Long texts are common, so each test first looks at the length or the first
character, which are cheap, and only then at the whole value. The result is
always that of the test on the whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from plumbline import rules

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_SHAPE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def stripped(c: Column) -> Column:
    """The text without white space at either end, Unicode spaces included."""
    spaces = F.lit(WHITESPACE)
    padded = F.contains(spaces, F.substring(c, 1, 1)) | F.contains(spaces, F.substring(c, -1, 1))
    return F.when(padded, F.btrim(c, spaces)).otherwise(c)


def normalised(c: Column) -> Column:
    return F.lower(stripped(c))


def is_empty(c: Column) -> Column:
    return F.octet_length(c) == 0


# The next three take stripped text, so that a caller strips once for all of them.

def is_blank(text: Column) -> Column:
    return F.octet_length(text) == 0


def is_placeholder(text: Column, words: tuple[str, ...] = rules.PLACEHOLDERS) -> Column:
    """Stands for a missing value ("n/a", "unknown", ...), ignoring case."""
    # A character takes four bytes at most, so longer text can't be in the list.
    return (F.octet_length(text) <= 4 * max(map(len, words))) & F.lower(text).isin(*words)


def is_number_text(text: Column) -> Column:
    """Text that reads as a number: 2, -1.5, 1e5, inf; not 1d, 0x1A or 1,000."""
    starts = F.substring(text, 1, 1).rlike(r"[0-9+\-.iI]")
    return starts & text.rlike(NUMBER_SHAPE)


def starts_with_letter(c: Column) -> Column:
    return F.substring(c, 1, 1).rlike("[A-Za-z]")


def matches_date_pattern(c: Column, pattern: str, anchored: bool) -> Column:
    if not anchored:
        return c.rlike(pattern)
    return F.substring(c, 1, 1).rlike(r"(?U)\d") & c.rlike(f"(?U)^(?:{pattern})")


def is_garbled(c: Column, any_non_ascii: bool) -> Column:
    """Encoding damage: known broken sequences, or any non-ASCII character."""
    non_ascii = F.octet_length(c) != F.length(c)
    if any_non_ascii:
        return non_ascii
    found = F.lit(False)
    for sequence in rules.MOJIBAKE:
        found = found | F.contains(c, F.lit(sequence))
    return non_ascii & found


def _longest(layout: str) -> int:
    """The length of the longest text that follows a date layout."""
    size = 0
    for run in re.finditer(r"(.)\1*", layout.replace("'", "")):
        letter, count = run.group(1), len(run.group())
        size += (2, 2, 3, 9)[count - 1] if letter == "M" else {"d": 2, "H": 2, "h": 2, "a": 2, "X": 6}.get(letter, count)
    return size


SHORTEST_DATE, LONGEST_DATE = 8, max(_longest(layout) for layout, _ in rules.DATE_FORMATS)


def date_text(c: Column) -> Column:
    """The text if it may be a date (a length that some layout has, and a year), else null."""
    return F.when(F.octet_length(c).between(SHORTEST_DATE, LONGEST_DATE) & c.rlike(r"\d{4}"), c)


def parsed_date(short: Column, layout: str, shape: str) -> Column:
    """A short text as a timestamp if it has this layout, else null."""
    return F.when(short.rlike(shape), F.try_to_timestamp(short, F.lit(layout)))


def group_key(c: Column) -> Column:
    """A short stand-in for a text as grouping key: itself, or its SHA-256 if long.

    Keeps long texts out of the shuffle. The prefix makes a digest longer than
    any text that stands for itself.
    """
    return F.when(F.octet_length(c) <= 64, c).otherwise(F.concat(F.lit("#"), F.sha2(c, 256)))
