"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

A document is measured by a few ratios. For each stratum (language) and ratio, labelled good
documents choose the cutoff beyond which documents go. Candidate cutoffs are fixed beforehand and
tested from the most lenient on: a cutoff holds if the exact binomial tail says that rejecting more
than its share of good documents is unlikely, P(Binomial(good, share) <= rejected) <= level. Testing
stops at the first that fails (fixed sequence, no correction needed along it); over ratios and
strata the level is divided (Bonferroni), and the limit is split over the ratios. So with
probability 1 - ``delta`` no stratum loses more than ``limit`` of its good documents to the learnt
cutoffs. Where labels are too few to prove that, nothing is rejected by them.

Measures need no shuffle; only counts per stratum, ratio and cutoff are shuffled.

Defined cases: a null text has no words and fails the base rules. A null language is the stratum ''.
Labels without a document, with a null or repeated id, or not 1, count nothing or once. Without good
labels only the base rules reject. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import NOT_BLANK, collapsed, column_or_null, let, split_collapsed, staged

LIMIT = 0.05
DELTA = 0.05
LEAST_WORDS = 50
WINDOW_WORDS = 3
LISTED_HASHES = 64
SYMBOLS = "#*$%&|<>"
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "word_chars"),
}
# Candidate cutoffs of every ratio, most lenient first.
CUTOFFS = (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)


def _repeat_words(words: Column, width: int) -> Column:
    """Number of words in windows of ``width`` words that the text has twice or more.

    Hashes choose the windows that may be repeated; only these are compared word by word."""
    last = F.size(words) - width
    everywhere = F.sequence(F.lit(0), last)

    def by_hash(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda o: F.array_distinct(F.array_compact(
            F.transform(o, lambda h, i: F.when(h == F.get(o, i + 1), h)))))
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(let(let(windows(hashes, t), places), covered)))

    def windows(hashes: Column, twice: Column) -> Column:
        # A long list isn't searched once for each word: then every window is compared.
        chosen = F.when(F.size(twice) > LISTED_HASHES, everywhere).otherwise(
            F.filter(everywhere, lambda i: F.array_contains(twice, F.get(hashes, i))))
        return F.sort_array(F.transform(chosen, lambda i: F.struct(
            F.concat_ws(" ", *[F.get(words, i + j) for j in range(width)]).alias("g"), i.alias("p"))))

    def places(ordered: Column) -> Column:
        same = lambda i, j: F.get(ordered, i)["g"] == F.get(ordered, j)["g"]
        equal = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.coalesce(same(i, i + 1), F.lit(False)) | (
            (i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))))
        return F.sort_array(F.transform(equal, lambda i: F.get(ordered, i)["p"]))

    def covered(found: Column) -> Column:
        steps = F.transform(found, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(found, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(everywhere, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, by_hash))


def _counted(docs: DataFrame, id_column: str, text_column: str, stratum_column: str, *carried: Column) -> DataFrame:
    """What is carried along, id, stratum, and the counts of words, lines and marks as structs."""
    text = F.coalesce(docs[text_column], F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_BLANK)), lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = let(collapsed(text), lambda c: let(split_collapsed(c), lambda w: F.struct(
        F.size(w).alias("n"), (F.char_length(c) - F.greatest(F.size(w) - 1, F.lit(0))).alias("chars"),
        _repeat_words(w, WINDOW_WORDS).alias("repeat"))))
    marks = let(F.regexp_replace(text, f"[^A-Z!{SYMBOLS}]+", ""), lambda m: F.struct(
        (F.char_length(m) - F.char_length(F.translate(m, SYMBOLS, ""))).alias("symbols"),
        (F.char_length(m) - F.char_length(F.replace(m, F.lit("!"), F.lit("")))).alias("exclamations"),
        F.char_length(F.regexp_replace(m, "[^A-Z]+", "")).alias("capitals")))
    stratum = F.coalesce(column_or_null(docs, stratum_column, "string"), F.lit(""))
    return docs.select(*carried, docs[id_column].alias("id"), stratum.alias("stratum"), words.alias("w"), lines.alias("l"), marks.alias("m"))


# Where each measure stands in the columns of ``_counted``.
MEASURES = {"n_words": ("w", "n"), "word_chars": ("w", "chars"), "n_symbols": ("m", "symbols"), "n_dup_lines": ("l", "dup"),
            "n_repeat_words": ("w", "repeat"), "n_lines": ("l", "n"), "n_capitals": ("m", "capitals"), "n_exclamations": ("m", "exclamations")}


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """id, stratum and the counts of every whole text."""
    return _counted(docs, id_column, text_column, stratum_column).select(
        "id", "stratum", *[F.col(f"{a}.{b}").cast("long").alias(name) for name, (a, b) in MEASURES.items()])


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 10."""
    z = x + F.lit(10.0)
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + (
        1 / (1260 * F.pow(z, F.lit(5.0))))
    for i in range(10):
        series = series - F.log(x + F.lit(float(i)))
    return series


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k) for k below the mean, 1 from the mean on. Terms beyond forty standard
    deviations are below the precision of a double."""
    odds = math.log(share), math.log1p(-share)
    top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * odds[0] + (n - k) * odds[1]
    terms = F.least(k, F.floor(40 * F.sqrt(n * share)) + 50).cast("int")
    summed = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) * (1 - share) / ((n - k + i + 1) * share)).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.when(k >= n * share, F.lit(1.0)).otherwise(F.exp(top) * summed)


def cutoffs(measures: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA,
            label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The certified cutoffs: stratum, ratio, cutoff, good, rejected. No row where none is certified."""
    good = labels.where(labels[label] == 1).select(labels[label_id].alias("id")).distinct()
    listed = F.array(*[F.struct(F.lit(name).alias("ratio"), F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).alias("value"))
                       for name, (a, b) in RATIOS.items()])
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    beyond = F.size(F.filter(grid, lambda c: F.col("x.value") <= c))  # how many of the most lenient keep it
    counts = (measures.join(good, "id").select("stratum", F.explode(listed).alias("x"))
              .groupBy("stratum", "x.ratio", beyond.alias("kept_by")).count())
    per = Window.partitionBy("stratum", "ratio")
    # Cutoff number i rejects the documents that fewer than i + 1 lenient cutoffs keep.
    steps = (counts.groupBy("stratum", "ratio").agg(F.sum("count").alias("good"), F.map_from_entries(
        F.collect_list(F.struct("kept_by", "count"))).alias("by"))
        .select("stratum", "ratio", "good", "by", F.posexplode(grid).alias("step", "cutoff"))
        .select("stratum", "ratio", "good", "step", "cutoff", F.aggregate(
            F.filter(F.map_entries("by"), lambda e: e["key"] <= F.col("step")), F.lit(0).cast("long"), lambda a, e: a + e["value"]).alias("rejected")))
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy("ratio")))
    share = limit / len(RATIOS)
    tested = steps.withColumn("holds", binomial_tail(F.col("good").cast("double"), F.col("rejected").cast("double"), share)
                              <= F.lit(delta / len(RATIOS)) / strata)
    unbroken = tested.withColumn("holds", F.min("holds").over(per.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return unbroken.where("holds").groupBy("stratum", "ratio").agg(
        F.min("cutoff").alias("cutoff"), F.max("good").alias("good"), F.max("rejected").alias("rejected"))


def judged(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA, id_column: str = "doc_id",
           text_column: str = "text", stratum_column: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    measures = staged(measured(docs, id_column, text_column, stratum_column), "measures")
    chosen = staged(_by_stratum(cutoffs(measures, labels, limit, delta, label_id, label)), "cutoffs")
    found = measures.join(chosen, measures["stratum"] == chosen["s"], "left")
    return found.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~(base_failed() | _rejected(F.col("c")))).alias("kept"))


def _by_stratum(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy(F.col("stratum").alias("s")).agg(
        F.map_from_entries(F.collect_list(F.struct("ratio", "cutoff"))).alias("c"))


Measure = Callable[[str], Column]


def base_failed(measure: Measure = F.col) -> Column:
    return (measure("n_words") < LEAST_WORDS) | (100 * measure("n_repeat_words") > 50 * measure("n_words"))


def _rejected(cutoff: Column, measure: Measure = F.col) -> Column:
    """Whether a ratio is beyond its certified cutoff, if there is one."""
    found = F.lit(False)
    for name, (a, b) in RATIOS.items():
        found = found | F.coalesce(F.try_divide(measure(a), measure(b)) > F.try_element_at(cutoff, F.lit(name)), F.lit(False))
    return found


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              stratum_column: str = "lang", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts aren't shuffled: cutoffs are learnt in
    one pass over them, then each text is measured and judged where it lies."""
    measures = staged(measured(docs, id_column, text_column, stratum_column), "measures")
    chosen = staged(_by_stratum(cutoffs(measures, labels, label_id=label_id, label=label)), "cutoffs")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    again = _counted(docs, id_column, text_column, stratum_column, whole)
    found = again.join(chosen, again["stratum"] == chosen["s"], "left")
    # Bound once: a filter that named the measures one by one would count the text again for each.
    good = let(F.struct("w", "l", "m"), lambda x: ~(base_failed(_within(x)) | _rejected(F.col("c"), _within(x))))
    return found.where(good).select("_doc.*")


def _within(counts: Column) -> Measure:
    return lambda name: counts[MEASURES[name][0]][MEASURES[name][1]].cast("long")
