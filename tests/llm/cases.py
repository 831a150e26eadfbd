"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, row long, text_hash string, size string, "
          "fp double, key string, stratum string, names string, found string, label int")


def rows(pairs):
    """Documents from (doc_id, text), with extra columns whose names the operators use inside."""
    return [(i, t, ("en", "de", None)[n % 3], (None, "b", "a", "b")[n % 4], None if t is None else len(t), 1, 2, "x", None, 0.5, "k", "s",
             None, "f", 0) for n, (i, t) in enumerate(pairs)]


LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
CASES = [
    (0, "one two three four five"), (1, "one  two three\tfour five"), (2, None), (3, ""), (4, "  \n\t "), (5, "One Two THREE four five"),
    (6, "<|endoftext|> \\ ### </turn> 's"), (7, "äöü Ñandú 漢字 😀"), (8, "a"), (8, "a"), (9, LONG), (10, LONG + " end"),
    (11, "x" * 5000), (12, "line\nline\nline\n\nother\n"), (13, "spam eggs ham " * 60), (None, "no id here"), (None, None),
    (14, "Released under the MIT License. " + "text " * 60), (15, "one two three four five"), (8, "different text, same id"),
]


def table(spark, pairs=CASES):
    return spark.createDataFrame(rows(pairs), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
