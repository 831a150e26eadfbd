"""Rule profiles: every threshold, word list and pattern the detectors use, as data.

Two profiles exist and stay separate. ``AUDIT`` is the stricter dimension audit,
``UNIVERSAL`` the size- and diversity-adjusted one. They differ in word lists,
thresholds, patterns and formulas.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values
# The lists, weights, thresholds and patterns below are fixed: results depend on
# each of them, so change them only on purpose.

PLACEHOLDERS = (
    "n/a", "na", "none", "null", "nil", "-", "--", "?",
    "unknown", "undefined", "missing", "tbd", "tbc", "#n/a",
)
PLACEHOLDERS_UNIVERSAL = PLACEHOLDERS + ("not available", "not applicable")

ID_KEYWORDS = ("id", "index", "uuid", "key", "code", "no", "num", "number", "ref")

DIMENSIONS = (
    "completeness", "uniqueness", "consistency", "validity",
    "accuracy", "structure", "correlation",
)
WEIGHTS = {
    "completeness": 0.28,
    "uniqueness": 0.18,
    "consistency": 0.16,
    "validity": 0.16,
    "accuracy": 0.10,
    "structure": 0.07,
    "correlation": 0.05,
}

# Tokens the CSV reader takes as null.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

DATE_PATTERNS_AUDIT = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{1,2} \w+ \d{4}",
)
DATE_PATTERNS_UNIVERSAL = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{1,2} [A-Za-z]{3} \d{4}",
    r"[A-Za-z]{3,9} \d{1,2},? \d{4}",
)
MOJIBAKE = ("â€", "Ã©", "Ã¨", "Â", "ï»¿")

# Text layouts tried when a string column may hold dates: (Spark format, shape).
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}$"),
    ("yyyy-MM-dd HH:mm:ssXXX", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}(Z|[+-]\d{2}:\d{2})$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
    ("MM/dd/yyyy HH:mm", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$"),
    ("dd/MM/yyyy HH:mm", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$"),
    ("d MMM yyyy HH:mm", r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}$"),
    ("MMM d, yyyy HH:mm:ss", r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{2}:\d{2}:\d{2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("MMM yyyy", r"^[A-Za-z]{3} \d{4}$"),
    ("MMMM yyyy", r"^[A-Za-z]{3,9} \d{4}$"),
    ("M/d/yyyy h:mm a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$"),
    ("M/d/yyyy h:mm:ss a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$"),
)
DATE_PARSE_SHARE = 0.7

CORRELATION_LIMIT = 0.95
PERFECT_CORRELATION = 0.999
EXTREME_FENCE = 3.0
BOX_FENCE = 1.5
NEAR_DISTANCE = 1e-6
KEEP_COLUMN_SHARE = 0.3
DISPLAY_ROWS = 50

@dataclass(frozen=True)
class RangeRule:
    """Values a numeric column may not hold, chosen by a substring of its name."""

    name: str
    words: tuple[str, ...]
    low: float | None
    high: float | None

    def applies_to(self, column: str) -> bool:
        lowered = column.lower()
        return any(word in lowered for word in self.words)


AGE_RULE = RangeRule("age", ("age", "years"), 0, 150)
PERCENT_RULE = RangeRule("percent", ("percent", "pct", "rate", "ratio"), 0, 100)
MONTH_RULE = RangeRule("month", ("month",), 1, 12)
MONEY_RULE = RangeRule("money", ("price", "salary", "cost", "amount", "revenue"), 0, None)
MONEY_RULE_UNIVERSAL = RangeRule(
    "money", ("price", "cost", "salary", "revenue", "amount", "fee"), 0, None)


@dataclass(frozen=True)
class RuleProfile:
    name: str
    placeholders: tuple[str, ...]
    case_max_distinct: int
    date_patterns: tuple[str, ...]
    date_anchored: bool
    date_min_distinct: int
    date_min_hits: int
    flags_any_non_ascii: bool
    consistency_penalty: float
    ranges: tuple[RangeRule, ...]
    skew_limit: float
    skew_min_count: int
    rows_per_column: float
    rows_per_column_penalty: float
    correlation_penalty: float


AUDIT = RuleProfile(
    name="audit",
    placeholders=PLACEHOLDERS,
    case_max_distinct=50,
    date_patterns=DATE_PATTERNS_AUDIT,
    date_anchored=True,
    date_min_distinct=6,
    date_min_hits=3,
    flags_any_non_ascii=False,
    consistency_penalty=120.0,
    ranges=(AGE_RULE, MONEY_RULE, PERCENT_RULE, MONTH_RULE),
    skew_limit=3.0,
    skew_min_count=3,
    rows_per_column=3.0,
    rows_per_column_penalty=15.0,
    correlation_penalty=5.0,
)
UNIVERSAL = RuleProfile(
    name="universal",
    placeholders=PLACEHOLDERS_UNIVERSAL,
    case_max_distinct=100,
    date_patterns=DATE_PATTERNS_UNIVERSAL,
    date_anchored=False,
    date_min_distinct=0,
    date_min_hits=1,
    flags_any_non_ascii=True,
    consistency_penalty=180.0,
    ranges=(AGE_RULE, MONEY_RULE_UNIVERSAL, PERCENT_RULE),
    skew_limit=2.0,
    skew_min_count=4,
    rows_per_column=5.0,
    rows_per_column_penalty=10.0,
    correlation_penalty=3.0,
)
PROFILES = {"audit": AUDIT, "universal": UNIVERSAL}
# ------------------------------------------------------------ end fixed values

# What reports call a role, and what to do with a column of it. Nothing depends on the wording.
TAG_LABELS = {
    "numeric": "measure",
    "categorical": "category",
    "binary": "two-valued",
    "id": "row identifier",
    "constant": "single value",
    "datetime": "date or time",
    "high_cardinality": "category with many values",
    "text": "prose",
    "unknown": "not recognised",
}
ENCODING_ADVICE = {
    "numeric": ("keep", "A model can read it as it stands; numeric_details shows whether its scale or skew calls for a transform"),
    "binary": ("map to 0 and 1", "value_counts gives the two values; numbers and booleans can stay"),
    "categorical": ("one column per value", "top_values lists the few values it holds"),
    "high_cardinality": ("replace by a statistic", "Join the frequency of each value, or the target's mean computed on other rows"),
    "id": ("leave out", "It names a row and tells nothing about new ones; keep it only as a join key"),
    "constant": ("leave out", "constant_columns shows that all rows agree"),
    "datetime": ("derive parts", "Calendar fields and time differences carry the signal, not the raw value"),
    "text": ("turn into vectors", "Term weights or embeddings; exact values hardly repeat"),
    "unknown": ("look at it", "Nested or empty; select a field of it first"),
}


def profile_named(name: str | RuleProfile) -> RuleProfile:
    if isinstance(name, RuleProfile):
        return name
    if name not in PROFILES:
        raise ValueError(f"unknown rule profile {name!r}; use one of {sorted(PROFILES)}")
    return PROFILES[name]
