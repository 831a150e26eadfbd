"""SQL that gives the same results as the registered queries, for an independent engine.

The texts are put together from per-column branches: the checked operators look at every
column of a table, and plain SQL has to name each one.
"""

from __future__ import annotations

from catalog.queries import AS_OF, ODD_NAMES
from catalog.tables import DIRTY_CUSTOMER_SQL
from plumbline import rules

ORACLES: dict[str, str] = {}

NUMBER, STRING, TIME, NESTED = "number", "string", "datetime", "other"
# table -> (column, type) in order
SCHEMAS = {
    "dirty_customer": [
        ("cust_id", "bigint"), ("segment", "string"), ("segment_case", "string"), ("balance_amount", "double"),
        ("age", "int"), ("birth_month", "int"), ("bal_a", "double"), ("bal_b", "double"), ("bal_a_copy", "double"),
        ("mixed_code", "string"), ("nation_text", "string"), ("joined_on", "string"), ("const_flag", "string"),
        ("sparse_note", "string"), ("label", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
}
KINDS = {"bigint": NUMBER, "int": NUMBER, "double": NUMBER, "string": STRING, "timestamp": TIME, "timestamp_ntz": TIME,
         "array<float>": NESTED}
WIDTHS = {"bigint": 8, "int": 4, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def kind(dtype: str) -> str:
    return KINDS[dtype]


def columns(name: str, *kinds: str) -> list[str]:
    return [c for c, t in SCHEMAS[name] if not kinds or kind(t) in kinds]


def source(name: str) -> str:
    return f"({DIRTY_CUSTOMER_SQL})" if name == "dirty_customer" else name


def with_table(name: str, *parts: str) -> str:
    """WITH t AS (the table), further parts; the table is used several times."""
    return "WITH " + ",\n".join([f"t AS MATERIALIZED (SELECT * FROM {source(name)} AS s)", *parts])


def union(branches: list[str]) -> str:
    return "\nUNION ALL\n".join(branches)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Fixed values, stated here once more so that an error in the checked lists shows.
SPACE_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
NUMBER_TEXT = "(?i)^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"
HOLDERS = ("-", "--", "?", "#n/a", "n/a", "na", "nil", "none", "null", "missing", "tbc", "tbd", "undefined", "unknown")
HOLDERS_UNIVERSAL = (*HOLDERS, "not applicable", "not available")
DAMAGE = ("Â", "Ã¨", "Ã©", "â€", "ï»¿")
NULLS = ("", "<NA>", "N/A", "n/a", "NA", "NULL", "null", "NaN", "nan", "None", "#NA", "#N/A", "#N/A N/A", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN")
ID_WORDS = ("code", "id", "index", "key", "no", "num", "number", "ref", "uuid")
WEIGHTS = {"completeness": 0.28, "uniqueness": 0.18, "consistency": 0.16, "validity": 0.16, "accuracy": 0.1, "structure": 0.07, "correlation": 0.05}

SPACES = " || ".join(f"chr({c})" for c in SPACE_CODES)


def strip(c: str) -> str:
    return f"trim({c}, {SPACES})"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def is_number(c: str) -> str:
    return f"regexp_matches({strip(c)}, {text(NUMBER_TEXT)})"


def is_holder(c: str, rule) -> str:
    return f"lower({strip(c)}) IN {words(HOLDERS_UNIVERSAL if rule.name == 'universal' else HOLDERS)}"


def garbled(c: str, rule) -> str:
    if rule.flags_any_non_ascii:
        return f"strlen({c}) <> length({c})"
    return "(" + " OR ".join(f"contains({c}, {text(m)})" for m in DAMAGE) + ")"


def date_hit(c: str, pattern: str, rule) -> str:
    pattern = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    return f"regexp_matches({c}, {text(('^' if rule.date_anchored else '') + pattern)})"


def count_if(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


def skew(c: str) -> str:
    return (f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 "
            f"ELSE skewness(CAST({c} AS DOUBLE)) END")


def kurt(c: str) -> str:
    return (f"CASE WHEN count({c}) < 4 THEN NULL WHEN min({c}) = max({c}) THEN 0.0 "
            f"ELSE kurtosis(CAST({c} AS DOUBLE)) END")


def quant(c: str, q: float) -> str:
    return f"quantile_cont(CAST({c} AS DOUBLE), {q})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# ------------------------------------------------------------------- profile

def _profile() -> None:
    d = source("dirty_customer")
    dirty = columns("dirty_customer")
    ORACLES["table_shape"] = f"SELECT count(*) AS n_rows, CAST({len(dirty)} AS BIGINT) AS n_columns FROM {d} AS t"
    nulls = " + ".join(f"count(*) - count({c})" for c in dirty)
    ORACLES["null_cells"] = f"SELECT {nulls} AS null_cells, count(*) * {len(dirty)} AS cells FROM {d} AS t"

    def duplicate_sql(rows: str) -> str:
        return (f"WITH g AS (SELECT count(*) AS n FROM ({rows}) AS r GROUP BY ALL_COLUMNS) "
                "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct_rows, "
                "CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g")

    for key, cols, rows in (
            ("duplicate_rows", dirty, f"SELECT * FROM {d} AS t"),
            ("duplicate_rows_lineitem", columns("lineitem"), "SELECT * FROM lineitem"),
            ("duplicate_texts", ["text", "lang", "source", "n_chars"], "SELECT * FROM documents")):
        ORACLES[key] = duplicate_sql(rows).replace("ALL_COLUMNS", ", ".join(cols))
    ORACLES["size_estimate"] = union([
        f"SELECT '{c}' AS \"column\", " + (f"{big(f'coalesce(sum(strlen({c})), 0)')}" if t == "string"
                                          else f"count(*) * {WIDTHS[t]}") + " AS bytes FROM documents"
        for c, t in SCHEMAS["documents"]])
    ORACLES["first_rows"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 5"
    ORACLES["last_rows"] = "SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5"

    def details(name: str, key: str | None) -> str:
        branches = []
        for c, t in SCHEMAS[name]:
            sample = f", arg_min(CAST({c} AS VARCHAR), {key}) FILTER (WHERE {c} IS NOT NULL) AS sample" if key else ""
            branches.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
                            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, "
                            f"count(DISTINCT {c}) AS n_distinct{sample} FROM t")
        return with_table(name) + "\n" + union(branches)

    ORACLES["profile_columns"] = details("dirty_customer", "cust_id")
    ORACLES["profile_columns_orders"] = details("orders", "o_orderkey")
    ORACLES["profile_columns_lineitem"] = details("lineitem", None)
    ORACLES["profile_columns_embeddings"] = details("embeddings", None)

    def describe(name: str) -> str:
        branches = []
        for c, t in SCHEMAS[name]:
            of = {n: "CAST(NULL AS DOUBLE)" for n in ("mean", "std", "min", "q25", "q50", "q75", "max")}
            ts = {n: "CAST(NULL AS TIMESTAMP)" for n in ("ts_mean", "ts_min", "ts_q25", "ts_q50", "ts_q75", "ts_max")}
            top = ["CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"]
            if kind(t) == STRING:
                best = f"(SELECT {{}} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                top = [f"count(DISTINCT {c})", best.format(c), best.format("count(*)")]
            elif kind(t) == NUMBER:
                of = {"mean": f"round(avg(CAST({c} AS DOUBLE)), 6)", "std": f"round(stddev_samp(CAST({c} AS DOUBLE)), 6)",
                      "min": f"CAST(min({c}) AS DOUBLE)", "q25": f"round({quant(c, .25)}, 6)",
                      "q50": f"round({quant(c, .5)}, 6)", "q75": f"round({quant(c, .75)}, 6)",
                      "max": f"CAST(max({c}) AS DOUBLE)"}
            else:
                def at(x: str) -> str:
                    return f"make_timestamp(CAST(trunc({x}) AS BIGINT))"
                micros = f"CAST(epoch_us({c}) AS DOUBLE)"
                ts = {"ts_mean": f"make_timestamp(CAST(sum(epoch_us({c})) // count({c}) AS BIGINT))", "ts_min": f"CAST(min({c}) AS TIMESTAMP)",
                      "ts_q25": at(f"quantile_cont({micros}, .25)"), "ts_q50": at(f"quantile_cont({micros}, .5)"),
                      "ts_q75": at(f"quantile_cont({micros}, .75)"), "ts_max": f"CAST(max({c}) AS TIMESTAMP)"}
            fields = [f"{v} AS \"{k}\"" for k, v in (("unique", top[0]), ("top", top[1]), ("freq", top[2]), *of.items(), *ts.items())]
            branches.append(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", " + ", ".join(fields) + " FROM t")
        return with_table(name) + "\n" + union(branches)

    ORACLES["describe_all"] = describe("customer")
    ORACLES["describe_events"] = describe("events")


# ---------------------------------------------------------------- classifier

DUCK_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y",
                "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
                "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", None, None, None,
                "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d/%m/%Y %H:%M", "%d %b %Y %H:%M", "%b %d, %Y %H:%M:%S",
                "%m/%d/%Y", "%d/%m/%Y", "%Y%m%d", "%b %Y", "%B %Y", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S %p")


_DAY, _LONG, _CLOCK = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[A-Za-z]{3,9}", "[0-9]{2}:[0-9]{2}"
_TWO, _ZONE, _HALF = "[0-9]{2}/[0-9]{2}/[0-9]{4}", "(Z|[+-][0-9]{2}:[0-9]{2})", "[0-9]{1,2}:[0-9]{2}"
_ANY = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
DUCK_SHAPES = tuple(f"^{shape}$" for shape in (
    _DAY, f"{_DAY} {_CLOCK}:[0-9]{{2}}", f"{_DAY}T{_CLOCK}:[0-9]{{2}}", "[0-9]{4}/[0-9]{2}/[0-9]{2}", _TWO, _TWO, "[0-9]{2}-[0-9]{2}-[0-9]{4}",
    "[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", f"[0-9]{{1,2}} {_LONG} [0-9]{{4}}", "[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", f"{_LONG} [0-9]{{1,2}}, [0-9]{{4}}",
    f"{_DAY} {_CLOCK}", f"{_DAY}T{_CLOCK}", f"{_DAY} {_CLOCK}:[0-9]{{2}}[.][0-9]{{1,6}}", f"{_DAY}T{_CLOCK}:[0-9]{{2}}[.][0-9]{{1,6}}",
    f"{_DAY} {_CLOCK}:[0-9]{{2}}{_ZONE}", f"{_DAY}T{_CLOCK}:[0-9]{{2}}{_ZONE}", f"{_DAY}T{_CLOCK}:[0-9]{{2}}[.][0-9]{{1,6}}{_ZONE}",
    f"[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {_CLOCK}:[0-9]{{2}}", f"{_TWO} {_CLOCK}", f"{_TWO} {_CLOCK}", f"[0-9]{{1,2}} [A-Za-z]{{3}} [0-9]{{4}} {_CLOCK}",
    f"[A-Za-z]{{3}} [0-9]{{1,2}}, [0-9]{{4}} {_CLOCK}:[0-9]{{2}}", _ANY, _ANY, "[0-9]{8}", "[A-Za-z]{3} [0-9]{4}", f"{_LONG} [0-9]{{4}}",
    f"{_ANY} {_HALF} [AaPp][Mm]", f"{_ANY} {_HALF}:[0-9]{{2}} [AaPp][Mm]"))


def parsed(c: str, i: int) -> str:
    time = f"TRY_CAST({c} AS TIMESTAMPTZ)" if DUCK_FORMATS[i] is None else f"try_strptime({c}, '{DUCK_FORMATS[i]}')"
    return f"CASE WHEN regexp_matches({c}, {text(DUCK_SHAPES[i])}) THEN CAST({time} AS TIMESTAMP) END"


def date_share(c: str) -> str:
    counts = ", ".join(f"count({parsed(c, i)})" for i in range(len(DUCK_FORMATS)))
    return f"CASE WHEN count({c}) > 0 THEN greatest({counts}) * 1.0 / count({c}) END"


def id_name(name: str) -> bool:
    lowered = name.lower().strip()
    return any(lowered == k or lowered.startswith(k + "_") or lowered.endswith("_" + k) for k in ID_WORDS)


def roles(name: str, key: str | None = None) -> str:
    """A SELECT of column, kind, tag, null_pct, n_distinct, n_rows and sample from t."""
    branches = []
    for c, t in SCHEMAS[name]:
        k = kind(t)
        sample = f"arg_min(CAST({c} AS VARCHAR), {key}) FILTER (WHERE {c} IS NOT NULL)" if key else "NULL"
        share = date_share(c) if k == STRING else "NULL"
        branches.append(f"SELECT '{c}' AS \"column\", '{k}' AS kind, {str(id_name(c)).lower()} AS id_name, "
                        f"count(DISTINCT {c}) AS d, count(*) AS n, {share} AS share, "
                        f"round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, {sample} AS sample FROM t")
    tag = ("CASE WHEN kind = 'other' THEN 'unknown' WHEN d <= 1 THEN 'constant' "
           "WHEN d * 1.0 / n > 0.95 AND (id_name OR kind = 'string') THEN 'id' WHEN kind = 'datetime' THEN 'datetime' "
           "WHEN kind = 'string' AND share > 0.7 THEN 'datetime' WHEN kind = 'number' AND d = 2 THEN 'binary' "
           "WHEN kind = 'number' AND d <= 15 THEN 'categorical' WHEN kind = 'number' THEN 'numeric' "
           "WHEN d <= 20 THEN 'categorical' WHEN d * 1.0 / n > 0.5 THEN 'text' ELSE 'high_cardinality' END")
    return (f"SELECT \"column\", kind, {tag} AS tag, null_pct, d AS n_distinct, n AS n_rows, sample "
            f"FROM ({union(branches)}) AS b")


def lookup(values: dict[str, str], on: str) -> str:
    return "CASE " + " ".join(f"WHEN {on} = {text(k)} THEN {text(v)}" for k, v in values.items()) + " END"


def _classifier() -> None:
    label = lookup(rules.TAG_LABELS, "tag")
    ORACLES["classify_columns"] = (with_table("dirty_customer") + f"\nSELECT \"column\", tag, {label} AS label, null_pct, "
                                   f"n_distinct, sample FROM ({roles('dirty_customer', 'cust_id')}) AS r")
    for name in ("lineitem", "documents", "events"):
        ORACLES[f"classify_{name}"] = (with_table(name) + f"\nSELECT \"column\", tag, {label} AS label, null_pct, "
                                       f"n_distinct FROM ({roles(name)}) AS r")
    ORACLES["date_parse_share"] = with_table("dirty_customer") + "\n" + union(
        [f"SELECT '{c}' AS \"column\", round({date_share(c)}, 6) AS date_share FROM t"
         for c in columns("dirty_customer", STRING)])
    dirty = with_table("dirty_customer", f"r AS ({roles('dirty_customer')})")
    ORACLES["column_warnings"] = dirty + (
        "\nSELECT tag, count(*) AS n_columns, string_agg(\"column\", ', ' ORDER BY \"column\") AS columns FROM r "
        "WHERE tag IN ('id', 'constant', 'text') GROUP BY tag")
    advice = lookup({k: v[0] for k, v in rules.ENCODING_ADVICE.items()}, "tag")
    detail = lookup({k: v[1] for k, v in rules.ENCODING_ADVICE.items()}, "tag")
    ORACLES["encoding_advice"] = dirty + f"\nSELECT \"column\", tag, {advice} AS advice, {detail} AS detail FROM r"
    ORACLES["valid_targets"] = dirty + "\nSELECT \"column\", tag FROM r WHERE tag NOT IN ('id', 'constant', 'text')"
    ORACLES["column_header"] = (with_table("customer") + f"\nSELECT \"column\", tag, null_pct, n_distinct, n_rows "
                                f"FROM ({roles('customer')}) AS r WHERE \"column\" = 'c_mktsegment'")


# ------------------------------------------------------------------ explorer

def histogram(name: str, names: list[str]) -> str:
    branches = []
    for c in names:
        v = f"CAST({c} AS DOUBLE)"
        place = (f"CASE WHEN lo = hi THEN 1 ELSE least(CAST(floor(nb * ({v} - lo) / (hi - lo)) AS INTEGER) + 1, nb) END")
        branches.append(
            f"SELECT '{c}' AS \"column\", bin, round(lo + (hi - lo) / nb * (bin - 1), 6) AS low, "
            f"round(lo + (hi - lo) / nb * bin, 6) AS high, count(*) AS n FROM ("
            f"SELECT CAST({place} AS INTEGER) AS bin, lo, hi, nb FROM t, (SELECT CAST(min({c}) AS DOUBLE) AS lo, "
            f"CAST(max({c}) AS DOUBLE) AS hi, CAST(least(50, count(DISTINCT {c})) AS INTEGER) AS nb FROM t) AS e "
            f"WHERE {c} IS NOT NULL) AS b GROUP BY bin, lo, hi, nb")
    return with_table(name) + "\n" + union(branches)


def numeric_details(name: str, names: list[str]) -> str:
    return with_table(name) + "\n" + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"round({quant(c, .5)}, 6) AS median, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
        f"round({skew(c)}, 6) AS skewness, round({kurt(c)}, 6) AS kurtosis, "
        f"round({quant(c, .25)}, 6) AS q1, round({quant(c, .75)}, 6) AS q3 FROM t" for c in names])


def box(name: str, names: list[str]) -> str:
    branches = []
    for c in names:
        v = f"CAST({c} AS DOUBLE)"
        inside = f"{v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
        branches.append(
            f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, "
            f"round(min({v}) FILTER (WHERE {inside}), 6) AS whisker_low, "
            f"round(max({v}) FILTER (WHERE {inside}), 6) AS whisker_high, "
            f"count({c}) - count({c}) FILTER (WHERE {inside}) AS outliers FROM t, (SELECT {quant(c, .25)} AS q1, "
            f"{quant(c, .5)} AS q2, {quant(c, .75)} AS q3 FROM t) AS q GROUP BY q1, q2, q3")
    return with_table(name) + "\n" + union(branches)


def bounds(c: str, factor: float) -> str:
    return (f"(SELECT q1 - {factor} * (q3 - q1) AS low, q3 + {factor} * (q3 - q1) AS high, q3 - q1 AS span FROM "
            f"(SELECT {quant(c, .25)} AS q1, {quant(c, .75)} AS q3 FROM t) AS q) AS e")


def top(name: str, names: list[str], k: int) -> str:
    return with_table(name) + "\n" + union([
        f"SELECT '{c}' AS \"column\", CAST(rank AS INTEGER) AS rank, value, n, round(n * 100.0 / (SELECT count(*) FROM t), 1) AS pct FROM ("
        f"SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
        f"FROM t WHERE {c} IS NOT NULL GROUP BY {c}) AS v WHERE rank <= {k}" for c in names])


def class_balance(name: str, target: str) -> str:
    return (f"WITH v AS (SELECT {target}, count(*) AS n FROM {name} WHERE {target} IS NOT NULL GROUP BY {target}), "
            "s AS (SELECT count(*) AS k, sum(n) AS total, max(n) AS hi, min(n) AS lo FROM v) "
            f"SELECT '{target}' AS target, k AS n_classes, round(hi * 100.0 / total, 6) AS majority_pct, "
            "round(lo * 100.0 / total, 6) AS minority_pct, round(CAST(hi AS DOUBLE) / greatest(lo, 1), 6) AS imbalance_ratio, "
            "CASE WHEN hi * 1.0 / greatest(lo, 1) > 10 THEN 'severe' WHEN hi * 1.0 / greatest(lo, 1) > 3 THEN 'moderate' "
            "ELSE 'balanced' END AS verdict FROM s")


def corr(a: str, b: str) -> str:
    shared = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    varies = " AND ".join(f"min({x}) FILTER (WHERE {shared}) < max({x}) FILTER (WHERE {shared})" for x in (a, b))
    return f"CASE WHEN {varies} THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"


def pairs_sql(name: str) -> str:
    names = columns(name, NUMBER)
    return union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {corr(a, b)} AS r FROM t"
                  for i, a in enumerate(names) for b in names[i + 1:]])


def _explorer() -> None:
    ORACLES["histogram"] = histogram("events", ["value", "user_id"])
    ORACLES["histogram_dirty"] = histogram("dirty_customer", ["birth_month", "age", "bal_a"])
    numbers = columns("lineitem", NUMBER)
    ORACLES["numeric_summary"] = with_table("lineitem") + "\n" + union([
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)), 5) AS mean, round({quant(c, .5)}, 5) AS median, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)), 5) AS std, round({skew(c)}, 5) AS skewness, "
        f"CASE WHEN round({skew(c)}, 2) > 1 THEN 'right' WHEN round({skew(c)}, 2) < -1 THEN 'left' ELSE 'normal' END "
        f"AS skew_label FROM t" for c in numbers])
    ORACLES["numeric_details"] = numeric_details("events", ["value"])
    ORACLES["numeric_details_documents"] = numeric_details("documents", ["n_chars"])
    ORACLES["box_stats"] = box("lineitem", numbers)
    ORACLES["box_stats_events"] = box("events", ["value"])
    ORACLES["outlier_rows"] = (with_table("events") + "\nSELECT t.* REPLACE (round(value, 6) AS value) FROM t, "
                               + bounds("value", 1.5) + " WHERE value < low OR value > high ORDER BY event_id LIMIT 50")
    ORACLES["outlier_rows_all"] = (with_table("documents") + "\nSELECT doc_id, lang, source, n_chars FROM t, "
                                   + bounds("n_chars", 1.5) + " WHERE n_chars < low OR n_chars > high")
    ORACLES["outlier_summary"] = (
        with_table("events") + "\nSELECT 'value' AS \"column\", round(low, 6) AS lower_bound, round(high, 6) AS upper_bound, "
        + count_if("value < low OR value > high") + " AS outliers, round("
        + count_if("value < low OR value > high") + " * 100.0 / count(*), 6) AS outlier_pct FROM t, "
        + bounds("value", 1.5) + " GROUP BY low, high")
    ORACLES["value_counts_top20"] = top("dirty_customer", ["segment", "segment_case", "label", "nation_text", "mixed_code"], 20)
    ORACLES["value_counts_texts"] = top("dirty_customer", columns("dirty_customer", STRING), 20)
    ORACLES["value_counts_top30"] = top("events", ["event_type", "props"], 30)
    ORACLES["category_summary"] = with_table("dirty_customer") + "\n" + union([
        f"SELECT '{c}' AS \"column\", v AS top_value, n AS top_n, round(n * 100.0 / (SELECT count(*) FROM t), 1) AS pct, "
        f"round(n * 100.0 / (SELECT count(*) FROM t), 1) > 80 AS imbalanced, (SELECT count(DISTINCT {c}) FROM t) AS n_distinct "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1) AS b"
        for c in columns("dirty_customer", STRING)])
    ORACLES["column_modes"] = with_table("dirty_customer") + "\n" + union([
        f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM t) AS n_distinct, v AS mode, n FROM (SELECT {c} AS v, "
        f"count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1) AS b"
        for c in columns("dirty_customer", STRING)])
    half = f"p AS ({pairs_sql('lineitem')})"
    diagonal = union([f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0 END FROM t" for c in numbers])
    ORACLES["corr_matrix"] = with_table("lineitem", half) + (
        "\nSELECT column_a, column_b, round(r, 6) AS r FROM (SELECT * FROM p UNION ALL SELECT column_b, column_a, r FROM p "
        f"UNION ALL {diagonal}) AS m")
    r = "corr(l_quantity, l_extendedprice)"
    ORACLES["pair_correlation"] = (
        f"SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round({r}, 6) AS r, CASE WHEN abs({r}) > 0.9 THEN 'very high' "
        f"WHEN abs({r}) > 0.7 THEN 'strong' WHEN abs({r}) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem")
    ORACLES["ols_trend"] = (
        "SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, "
        "round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, "
        "round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, "
        "round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
    ORACLES["class_balance"] = class_balance("labels", "quality")
    ORACLES["class_balance_orders"] = class_balance("orders", "o_orderpriority")
    ORACLES["class_counts"] = "SELECT o_orderstatus AS class, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus"
    ORACLES["regression_target"] = (
        f"SELECT 'n_chars' AS target, round(avg(n_chars), 6) AS mean, round({quant('n_chars', .5)}, 6) AS median, "
        f"round(stddev_samp(n_chars), 6) AS std, round({skew('n_chars')}, 6) AS skewness, "
        f"CASE WHEN abs({skew('n_chars')}) > 2 THEN 'log transform' ELSE 'suitable' END AS advice FROM documents")
    ORACLES["distinct_sample"] = (f"SELECT min(cust_id) AS first_at, mixed_code AS value FROM {source('dirty_customer')} AS t "
                                  "WHERE mixed_code IS NOT NULL GROUP BY mixed_code ORDER BY first_at LIMIT 30")


# ----------------------------------------------------------------- detectors

def missing_branch(c: str, is_text: bool, rule) -> str:
    blank = count_if(f"{strip(c)} = ''") if is_text else "0"
    empty = count_if(f"{c} = ''") if is_text else "0"
    holder = count_if(is_holder(c, rule)) if is_text else "0"
    return (f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS nulls, {empty} AS empty_cells, "
            f"{blank} - {empty} AS whitespace_cells, {holder} AS placeholder_cells, "
            f"count(*) - count({c}) + {blank} + {holder} AS missing_cells FROM t")


def missing_select(name: str, rule) -> str:
    raw = union([missing_branch(c, kind(t) == STRING, rule) for c, t in SCHEMAS[name]])
    pct = "round(nulls * 100.0 / n_rows, 1)"
    return ("SELECT \"column\", n_rows, nulls, CAST(empty_cells AS BIGINT) AS empty_cells, "
            "CAST(whitespace_cells AS BIGINT) AS whitespace_cells, CAST(placeholder_cells AS BIGINT) AS placeholder_cells, "
            f"CAST(missing_cells AS BIGINT) AS missing_cells, {pct} AS null_pct, "
            "round(missing_cells * 100.0 / n_rows, 2) AS missing_pct, "
            f"CASE WHEN {pct} > 40 THEN 'critical' WHEN {pct} > 5 THEN 'moderate' END AS severity FROM ({raw}) AS m")


def label_select(name: str) -> str:
    """column, n_values, n_stripped, n_labels, noisy_labels for text columns with at most 100 labels."""
    branches = []
    for c in columns(name, STRING):
        branches.append(
            f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM t) AS n_values, "
            f"(SELECT count(DISTINCT {strip(c)}) FROM t) AS n_stripped, "
            f"(SELECT count(DISTINCT lower({strip(c)})) FROM t) AS n_labels, "
            f"{big('coalesce(sum(k - 1), 0)')} AS noisy_labels, min(a || ' ~ ' || z) FILTER (WHERE k > 1) AS noisy_example "
            f"FROM (SELECT count(*) AS k, min(v) AS a, max(v) AS z FROM "
            f"(SELECT DISTINCT lower({strip(c)}) AS v FROM t WHERE {c} IS NOT NULL) AS l WHERE length(v) >= 2 "
            f"GROUP BY substring(v, 1, 2)) AS g")
    return f"SELECT * FROM ({union(branches)}) AS l WHERE n_values > 0"


def mixed_select(name: str) -> str:
    return "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", {count_if(is_number(c))} AS numeric_like, "
        + count_if(f"regexp_matches({c}, '^[A-Za-z]')") + f" AS letter_first, count({c}) AS present FROM t"
        for c in columns(name, STRING)]) + ") AS m WHERE numeric_like > 0 AND numeric_like < present AND letter_first > 0"


def case_select(rule) -> str:
    return (f"SELECT \"column\", n_stripped, n_labels, n_stripped - n_labels AS extra_labels FROM labels "
            f"WHERE n_values <= {rule.case_max_distinct} AND n_labels < n_stripped")


def date_select(name: str, rule) -> str:
    branches = []
    for c in columns(name, STRING):
        hits = " + ".join(f"CASE WHEN {count_if(date_hit(c, p, rule))} >= {rule.date_min_hits} THEN 1 ELSE 0 END"
                          for p in rule.date_patterns)
        branches.append(f"SELECT '{c}' AS \"column\", {big(hits)} AS formats_found, count(DISTINCT {c}) AS d FROM t")
    return (f"SELECT \"column\", formats_found FROM ({union(branches)}) AS f WHERE formats_found > 1 "
            f"AND d >= {rule.date_min_distinct}")


def garbled_select(name: str, rule) -> str:
    return "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", {count_if(garbled(c, rule))} AS affected_rows FROM t"
        for c in columns(name, STRING)]) + ") AS g WHERE affected_rows > 0"


def issue_select(name: str, rule) -> str:
    return union([
        f"SELECT 'mixed_type' AS issue, \"column\", numeric_like AS n FROM ({mixed_select(name)}) AS a",
        f"SELECT 'date_format', \"column\", formats_found FROM ({date_select(name, rule)}) AS b",
        f"SELECT 'case', \"column\", extra_labels FROM ({case_select(rule)}) AS c",
        f"SELECT 'encoding', \"column\", affected_rows FROM ({garbled_select(name, rule)}) AS d"])


def outlier_select(name: str) -> str:
    branches = []
    for c in columns(name, NUMBER):
        v = f"CAST({c} AS DOUBLE)"
        test = f"span > 0 AND ({v} < low OR {v} > high)"
        branches.append(f"SELECT '{c}' AS \"column\", count({c}) AS present, CASE WHEN count({c}) >= 4 THEN {count_if(test)} "
                        f"ELSE 0 END AS outliers, low, high, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi "
                        f"FROM t, {bounds(c, 3.0)} GROUP BY low, high, span")
    return union(branches)


def impossible_select(name_columns: list[str], rule) -> str:
    branches = []
    for c in name_columns:
        for r in rule.ranges:
            if r.applies_to(c):
                test = " OR ".join(f"{c} {op} {v}" for op, v in (("<", r.low), (">", r.high)) if v is not None)
                branches.append(f"SELECT '{c}' AS \"column\", '{r.name}' AS rule, CASE WHEN count({c}) >= 4 "
                                f"THEN {count_if(test)} ELSE 0 END AS bad_values FROM t")
    return f"SELECT \"column\", rule, bad_values FROM ({union(branches)}) AS i WHERE bad_values > 0"


def skew_select(name: str, rule) -> str:
    return "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", {skew(c)} AS skewness, count({c}) AS n FROM t"
        for c in columns(name, NUMBER)]) + f") AS s WHERE n >= {rule.skew_min_count} AND abs(skewness) > {rule.skew_limit}"


def constant_select(name: str) -> str:
    return "SELECT \"column\" FROM (" + union([
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d FROM t" for c in columns(name)]) + ") AS c WHERE d <= 1"


def identical_select(name: str) -> str:
    cols = SCHEMAS[name]
    branches = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM t"
                for i, (a, ta) in enumerate(cols) for b, tb in cols[i + 1:] if ta == tb]
    return f"SELECT column_a, column_b FROM ({union(branches)}) AS i WHERE same"


def text_number_select(name: str) -> str:
    return "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", {count_if(is_number(c))} * 1.0 / count(*) AS numeric_share FROM t"
        for c in columns(name, STRING)]) + ") AS x WHERE numeric_share > 0.95"


def near_select(names: list[str]) -> str:
    """n_rows and near_rows by comparing every row with every other."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in names)
    apart = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in names)
    return (f"SELECT count(*) AS n_rows, {big('coalesce(sum(CASE WHEN near THEN 1 ELSE 0 END), 0)')} AS near_rows FROM "
            f"(SELECT EXISTS (SELECT 1 FROM num AS b WHERE b.rid <> a.rid AND sqrt({apart}) < 1e-6) AS near FROM num AS a) AS z",
            f"num AS MATERIALIZED (SELECT row_number() OVER () AS rid, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names) + f" FROM t WHERE {present})")


def _detectors() -> None:
    labels = f"labels AS MATERIALIZED ({label_select('dirty_customer')})"
    dirty = with_table("dirty_customer")
    for rule in (rules.AUDIT, rules.UNIVERSAL):
        p = rule.name
        ORACLES[f"missing_by_column_{p}"] = dirty + "\n" + missing_select("dirty_customer", rule)
        ORACLES[f"missing_by_column_documents_{p}"] = with_table("documents") + "\n" + missing_select("documents", rule)
        ORACLES[f"case_issues_{p}"] = with_table("dirty_customer", labels) + "\n" + case_select(rule)
        ORACLES[f"date_format_mix_{p}"] = dirty + "\n" + date_select("dirty_customer", rule)
        ORACLES[f"date_format_mix_documents_{p}"] = with_table("documents") + "\n" + date_select("documents", rule)
        ORACLES[f"garbled_text_{p}"] = dirty + "\n" + garbled_select("dirty_customer", rule)
        ORACLES[f"garbled_text_documents_{p}"] = with_table("documents") + "\n" + garbled_select("documents", rule)
        ORACLES[f"consistency_issues_{p}"] = with_table("dirty_customer", labels) + "\n" + issue_select("dirty_customer", rule)
        ORACLES[f"impossible_values_{p}"] = dirty + "\n" + impossible_select(columns("dirty_customer", NUMBER), rule)
        ORACLES[f"impossible_values_lineitem_{p}"] = (
            "WITH t AS (SELECT l_discount * 2000 - 10 AS discount_rate, l_tax - 0.01 AS tax_amount, "
            "l_linenumber * 2 - 1 AS ship_month, l_quantity FROM lineitem)\n"
            + impossible_select(["discount_rate", "tax_amount", "ship_month", "l_quantity"], rule))
        extreme = "CASE WHEN abs(skewness) > 5 THEN 'extreme' ELSE 'high' END"
        for key, name in ((f"skewed_columns_{p}", "dirty_customer"), (f"skewed_columns_labels_{p}", "labels")):
            ORACLES[key] = (with_table(name) + f"\nSELECT \"column\", round(skewness, 6) AS skewness, {extreme} AS severity "
                            f"FROM ({skew_select(name, rule)}) AS k")
        blank_text = {c: t for c, t in SCHEMAS["customer"]}
        issue = {"audit": ["unnamed", "blank", "special", None, None],
                 "universal": ["unnamed", "blank", "special", "spaces", None]}[p]
        ORACLES[f"bad_names_{p}"] = "SELECT * FROM (" + union([
            f"SELECT {text(odd)} AS \"column\", {text(i)} AS issue, count({c}) AS cells FROM customer"
            for odd, c, i in zip(ODD_NAMES, blank_text, issue) if i]) + ") AS b"
    ORACLES["missing_totals"] = dirty + (
        "\nSELECT CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(empty_cells) AS BIGINT) AS empty_cells, "
        "CAST(sum(whitespace_cells) AS BIGINT) AS whitespace_cells, CAST(sum(placeholder_cells) AS BIGINT) AS placeholder_cells, "
        "CAST(sum(missing_cells) AS BIGINT) AS missing_cells, CAST(sum(n_rows) AS BIGINT) AS cells, "
        f"{count_if('missing_cells > 0')} AS columns_affected, {count_if('nulls = n_rows')} AS empty_columns, "
        + count_if("severity = 'critical'") + " AS critical_columns, " + count_if("severity = 'moderate'")
        + " AS moderate_columns, round(CAST(sum(missing_cells) AS DOUBLE) / sum(n_rows), 6) AS missing_rate "
        f"FROM ({missing_select('dirty_customer', rules.UNIVERSAL)}) AS m")
    ORACLES["worst_columns"] = dirty + (
        f"\nSELECT \"column\", missing_pct FROM ({missing_select('dirty_customer', rules.UNIVERSAL)}) AS m "
        "WHERE missing_cells > 0 ORDER BY missing_pct DESC LIMIT 20")
    ORACLES["constant_columns"] = dirty + "\n" + constant_select("dirty_customer")
    ORACLES["identical_columns"] = dirty + "\n" + identical_select("dirty_customer")
    cols = ", ".join(columns("dirty_customer"))
    ORACLES["duplicate_members"] = dirty + (
        f"\nSELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c, t in SCHEMAS['dirty_customer'] if t == 'double')}) "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY {cols}) AS copies FROM t) AS w "
        "WHERE copies > 1 ORDER BY cust_id NULLS FIRST LIMIT 50")
    for key, name, names in (("near_duplicates", "part", ["p_size", "p_retailprice"]),
                             ("near_duplicates_dirty", "dirty_customer", columns("dirty_customer", NUMBER))):
        select, num = near_select(names)
        ORACLES[key] = with_table(name, num) + ("\nSELECT n_rows, near_rows, round(near_rows * 100.0 / n_rows, 6) AS near_pct "
                                               f"FROM ({select}) AS y")
    ORACLES["mixed_types"] = dirty + "\n" + mixed_select("dirty_customer")
    ORACLES["mixed_types_documents"] = with_table("documents") + "\n" + mixed_select("documents")
    few = "n_labels <= 100"
    ORACLES["label_stats"] = with_table("dirty_customer", labels) + f"\nSELECT * FROM labels WHERE {few}"
    ORACLES["label_noise"] = with_table("dirty_customer", labels) + (
        "\nSELECT \"column\", n_labels, noisy_labels, noisy_example FROM labels WHERE n_labels BETWEEN 2 AND 30 AND noisy_labels > 0")
    for key, name in (("outlier_columns", "dirty_customer"), ("outlier_columns_events", "events")):
        ORACLES[key] = with_table(name) + (
            "\nSELECT \"column\", outliers, round(outliers * 100.0 / present, 6) AS outlier_pct, "
            "CASE WHEN outliers * 100.0 / present > 5 THEN 'high' ELSE 'low' END AS severity, round(low, 6) AS lower_bound, "
            "round(high, 6) AS upper_bound, round(lo, 6) AS min_value, round(hi, 6) AS max_value "
            f"FROM ({outlier_select(name)}) AS o WHERE outliers > 0")
    for key, name in (("future_dates", "events"), ("future_dates_text", "dirty_customer")):
        branches = []
        for c, t in SCHEMAS[name]:
            if kind(t) == TIME:
                branches.append(f"SELECT '{c}' AS \"column\", " + count_if(f"{c} > TIMESTAMP '{AS_OF}'") + " AS future_dates FROM t")
            elif kind(t) == STRING:
                best = " UNION ALL ".join(
                    f"SELECT count({parsed(c, i)}) AS k, {i} AS o, " + count_if(f"{parsed(c, i)} > TIMESTAMP '{AS_OF}'")
                    + " AS f FROM t" for i in range(len(DUCK_FORMATS)))
                branches.append(f"SELECT '{c}' AS \"column\", f AS future_dates FROM ({best} ORDER BY k DESC, o LIMIT 1) AS b")
        ORACLES[key] = with_table(name) + f"\nSELECT * FROM ({union(branches)}) AS f WHERE future_dates > 0"
    ORACLES["imbalance"] = (
        "WITH t AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 400000 THEN 'high' "
        "WHEN o_totalprice < 2000 THEN 'low' ELSE 'usual' END AS price_class FROM orders)\n" + "SELECT * FROM (" + union([
            f"SELECT '{c}' AS \"column\", v AS dominant_class, round(n * 100.0 / (SELECT count({c}) FROM t), 6) AS dominant_pct, "
            f"(SELECT count(DISTINCT {c}) FROM t) AS n_classes FROM (SELECT {c} AS v, count(*) AS n FROM t "
            f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1) AS b"
            for c in ("o_orderstatus", "o_orderpriority", "price_class")])
        + ") AS i WHERE dominant_pct > 85 AND n_classes >= 2")
    ORACLES["numbers_as_text"] = dirty + (f"\nSELECT \"column\", round(numeric_share, 6) AS numeric_share "
                                         f"FROM ({text_number_select('dirty_customer')}) AS x")
    tagged = ", ".join(f"'n:' || CAST({c} AS DOUBLE)" if kind(t) == NUMBER else f"'s:' || {c}"
                       for c, t in SCHEMAS["dirty_customer"])
    empty = " AND ".join(f"{c} IS NULL" for c in columns("dirty_customer"))
    ORACLES["row_shape"] = dirty + (f"\nSELECT count(*) AS n_rows, {count_if(empty)} AS empty_rows, "
                                    + count_if(f"list_unique(list_value({tagged})) = 1") + " AS uniform_rows FROM t")
    ORACLES["row_shape_nation"] = ("SELECT count(*) AS n_rows, " + count_if("n_nationkey IS NULL AND n_regionkey IS NULL")
                                   + " AS empty_rows, " + count_if("n_nationkey = n_regionkey") + " AS uniform_rows FROM nation")
    pairs = f"p AS ({pairs_sql('dirty_customer')})"
    ORACLES["corr_pairs"] = with_table("dirty_customer", pairs) + (
        "\nSELECT column_a, column_b, round(abs(r), 6) AS abs_r, CASE WHEN abs(r) > 0.999 THEN 'perfect' ELSE 'very high' END "
        "AS strength FROM p WHERE abs(r) > 0.95")
    ORACLES["redundant_columns"] = with_table("dirty_customer", pairs) + (
        "\nSELECT DISTINCT column_b AS \"column\" FROM p WHERE abs(r) > 0.999")


# -------------------------------------------------------------------- scores

def score_parts(name: str, rule) -> list[str]:
    """CTEs that end in ``scores``: dimension, score with two decimals."""
    k = len(SCHEMAS[name])
    cols = ", ".join(columns(name))
    universal = rule.name == "universal"
    n = "(SELECT count(*) FROM t)"
    rate = "(SELECT CAST(sum(missing_cells) AS DOUBLE) / sum(n_rows) FROM missing)"
    if universal:
        complete = f"greatest(0, 100 - 150 * {rate})"
        near, num = near_select(columns(name, NUMBER))
        dup = "(d.duplicates * 1.0 / d.n + 0.3 * round(e.near_rows * 100.0 / e.n_rows, 2) / 100)"
        unique = f"SELECT greatest(0, 100 - 200 * {dup}) FROM dup AS d, near AS e"
    else:
        complete = (f"CASE WHEN {rate} = 0 THEN 100 WHEN {rate} < 0.01 THEN 98 WHEN {rate} < 0.05 THEN 90 - 200 * {rate} "
                    f"WHEN {rate} < 0.2 THEN 80 - 150 * {rate} ELSE greatest(0, 50 - 100 * {rate}) END")
        unique = ("SELECT greatest(0, 100 - least(150.0 * duplicates / n, 60) - least(5 * (SELECT count(*) FROM constant) "
                  "+ 8 * (SELECT count(*) FROM identical), 30)) FROM dup")
    outliers = "(SELECT CAST(sum(outliers) AS DOUBLE) / greatest(sum(present), 1) FROM outliers)"
    hits, bad = "(SELECT count(*) FROM impossible)", "(SELECT coalesce(sum(bad_values), 0) FROM impossible)"
    valid = (f"greatest(0, 100 - 60 * {outliers} - 100.0 * {bad} / {n})" if universal
             else f"greatest(0, 100 - 80 * {outliers} - least(10 * {hits}, 40))")
    imbalanced = "(SELECT count(*) FROM imbalanced)"
    exact = ("greatest(0, 100 - 100 * (SELECT coalesce(sum(least(abs(skewness) / 20, 0.05)), 0) FROM skewed) "
             f"- 20.0 * {imbalanced} / {max(1, len(columns(name, STRING)))})" if universal else
             "greatest(0, 100 - least(4 * (SELECT count(*) FROM skewed), 30) - least(8 * (SELECT coalesce(sum(noisy_labels), 0) "
             "FROM labels WHERE n_labels BETWEEN 2 AND 30), 40))")
    ratio = f"CASE WHEN {n} * 1.0 / {k} < {rule.rows_per_column} THEN {rule.rows_per_column_penalty} ELSE 0 END"
    wrong = "(SELECT count(*) FROM textnum)"
    shape = (f"greatest(0, 100 - 30.0 * {wrong} / {k} - {ratio})" if universal
             else f"greatest(0, 100 - least(60.0 * {wrong} / {k}, 50) - {ratio})")
    steps = {
        "completeness": complete, "uniqueness": f"({unique})",
        "consistency": f"greatest(0, 100 - {rule.consistency_penalty} * (SELECT count(*) FROM issues) / {k})",
        "validity": valid, "accuracy": exact, "structure": shape,
        "correlation": f"greatest(0, 100 - {rule.correlation_penalty} * (SELECT count(*) FROM pairs WHERE abs(r) > 0.95))",
    }
    dominant = union([
        f"SELECT '{c}' AS \"column\" FROM (SELECT {c}, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}) AS v "
        f"HAVING count(*) >= 2 AND max(n) * 1.0 / sum(n) > 0.85" for c in columns(name, STRING)])
    parts = [
        f"labels AS MATERIALIZED ({label_select(name)})",
        f"missing AS MATERIALIZED ({missing_select(name, rule)})",
        f"dup AS MATERIALIZED (SELECT sum(c) AS n, sum(c - 1) AS duplicates FROM (SELECT count(*) AS c FROM t GROUP BY {cols}) AS g)",
        f"constant AS MATERIALIZED ({constant_select(name)})", f"identical AS MATERIALIZED ({identical_select(name)})",
        f"issues AS MATERIALIZED ({issue_select(name, rule)})", f"outliers AS MATERIALIZED ({outlier_select(name)})",
        f"skewed AS MATERIALIZED ({skew_select(name, rule)})", f"textnum AS MATERIALIZED ({text_number_select(name)})",
        f"pairs AS MATERIALIZED ({pairs_sql(name)})", f"imbalanced AS MATERIALIZED ({dominant})",
    ]
    rule_hits = any(r.applies_to(c) for c in columns(name, NUMBER) for r in rule.ranges)
    parts.append("impossible AS MATERIALIZED (" + (impossible_select(columns(name, NUMBER), rule) if rule_hits else
                 "SELECT '' AS \"column\", '' AS rule, 0 AS bad_values WHERE false") + ")")
    if universal:
        parts += [num, f"near AS MATERIALIZED ({near})"]
    parts.append("scores AS MATERIALIZED (" + union([
        f"SELECT {i} AS position, '{d}' AS dimension, CAST({WEIGHTS[d]} AS DOUBLE) AS weight, round(CAST({steps[d]} AS DOUBLE), 2) AS score"
        for i, d in enumerate(WEIGHTS, 1)]) + ")")
    return parts


QUICK = ("0.28 * greatest(0, 100 - 150.0 * nulls / (n * k)) + 0.18 * greatest(0, 100 - 200.0 * duplicates / n) "
         "+ 80 * (0.16 + 0.16 + 0.10 + 0.07 + 0.05)")
SIZE = "greatest(0.5, least(1.0, log10(n + 1) / 4))"


def quick_select(rows: str, cols: list[str], diversity: float) -> str:
    nulls = " + ".join(f"count(*) - count({c})" for c in cols)
    return (f"SELECT n AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns, nulls AS null_cells, duplicates AS duplicate_rows, "
            f"round(raw, 6) AS raw, round({SIZE}, 6) AS size_factor, CAST({diversity} AS DOUBLE) AS diversity, "
            f"round(least(100, greatest(0, raw * {SIZE} * {diversity})), 2) AS score FROM (SELECT *, {QUICK} AS raw FROM "
            f"(SELECT count(*) AS n, {len(cols)} AS k, {nulls} AS nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {rows}) AS u) "
            f"AS duplicates FROM {rows}) AS a) AS b")


def _scores() -> None:
    audit = with_table("dirty_customer", *score_parts("dirty_customer", rules.AUDIT))
    universal = with_table("dirty_customer", *score_parts("dirty_customer", rules.UNIVERSAL))
    columns_sql = "dimension, weight, score, round(weight * score, 6) AS weighted"
    band = "CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'bad' END AS band"
    ORACLES["dqs_audit"] = audit + f"\nSELECT {columns_sql}, {band} FROM scores"
    grade = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END"
    ORACLES["dqs_audit_summary"] = audit + (
        f"\nSELECT 'audit' AS profile, n AS n_rows, score, {grade} AS grade FROM (SELECT (SELECT count(*) FROM t) AS n, "
        "round(sum(weight * score), 2) AS score FROM scores) AS s")
    ORACLES["dqs_universal"] = universal + f"\nSELECT {columns_sql} FROM scores"
    status = ("CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' "
              "WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END")
    total = (f"(SELECT n, raw, {SIZE} AS size_factor, 1.03 AS diversity, round(least(100, greatest(0, raw * {SIZE} * 1.03)), 2) AS score "
             "FROM (SELECT (SELECT count(*) FROM t) AS n, sum(weight * score) AS raw FROM scores) AS s) AS f")
    ORACLES["dqs_universal_summary"] = universal + (
        f"\nSELECT 'universal' AS profile, n AS n_rows, round(raw, 6) AS raw, round(size_factor, 6) AS size_factor, "
        f"CAST(diversity AS DOUBLE) AS diversity, score, {status} AS grade FROM {total}")
    ORACLES["score_report"] = universal + (
        f"\nSELECT dimension, round(weight, 3) AS weight, score, round(weight * score, 2) AS weighted, {status} AS status "
        f"FROM scores UNION ALL SELECT 'final score', CAST(NULL AS DOUBLE), score, CAST(NULL AS DOUBLE), {status} FROM {total}")
    ORACLES["dqs_audit_lineitem"] = (with_table("lineitem", *score_parts("lineitem", rules.AUDIT))
                                     + f"\nSELECT {columns_sql} FROM scores")
    ORACLES["dqs_quick"] = with_table("dirty_customer") + "\n" + quick_select("t", columns("dirty_customer"), 1.03)
    user = {**WEIGHTS, "completeness": 0.5, "validity": 0.4}
    weight = "CASE " + " ".join(f"WHEN dimension = '{d}' THEN {w}" for d, w in user.items()) + f" END / CAST({sum(user.values())} AS DOUBLE)"
    ORACLES["user_weights"] = audit + (f"\nSELECT dimension, round({weight}, 6) AS weight, score, "
                                       f"round({weight} * score, 6) AS weighted FROM scores")
    disguised = "(SELECT sum(empty_cells + whitespace_cells + placeholder_cells) FROM missing)"
    rows_missing = "(SELECT count(*) FROM missing WHERE severity = {})"
    issue = "(SELECT count(*) FROM issues WHERE issue = '{}')"
    pair = "(SELECT count(*) FROM pairs WHERE abs(r) > 0.95 AND round(abs(r), 4) {} 0.999)"
    found = [
        ("completeness", 1, "high", "mostly_null", rows_missing.format("'critical'")),
        ("completeness", 2, "medium", "partly_null", rows_missing.format("'moderate'")),
        ("completeness", 3, "medium", "disguised", disguised),
        ("uniqueness", 1, "high", "duplicate_rows", "(SELECT duplicates FROM dup)"),
        ("uniqueness", 2, "medium", "constant_columns", "(SELECT count(*) FROM constant)"),
        ("uniqueness", 3, "medium", "identical_pairs", "(SELECT count(*) FROM identical)"),
        ("consistency", 1, "high", "mixed_type", issue.format("mixed_type")),
        ("consistency", 2, "medium", "date_format", issue.format("date_format")),
        ("consistency", 3, "medium", "case_columns", issue.format("case")),
        ("consistency", 4, "medium", "encoding", issue.format("encoding")),
        ("validity", 1, "high", "rules_hit", "(SELECT count(*) FROM impossible)"),
        ("validity", 2, "high", "outliers_high", "(SELECT count(*) FROM outliers WHERE outliers * 100.0 / present > 5)"),
        ("validity", 3, "medium", "outliers_low", "(SELECT count(*) FROM outliers WHERE outliers > 0 AND outliers * 100.0 / present <= 5)"),
        ("accuracy", 1, "medium", "skewed_columns", "(SELECT count(*) FROM skewed)"),
        ("accuracy", 2, "medium", "noisy_columns", "(SELECT count(*) FROM labels WHERE n_labels BETWEEN 2 AND 30 AND noisy_labels > 0)"),
        ("structure", 3, "medium", "text_numbers", "(SELECT count(*) FROM textnum)"),
        ("correlation", 1, "high", "near_identical", pair.format(">")),
        ("correlation", 2, "medium", "highly_correlated", pair.format("<=")),
    ]
    listed = "SELECT * FROM (" + union([
        f"SELECT '{d}' AS dimension, {i} AS finding_rank, '{s}' AS severity, '{k}' AS finding_type, {big(x)} AS n"
        for d, i, s, k, x in found]) + ") AS f WHERE n > 0"
    ORACLES["findings"] = audit + "\n" + listed
    ORACLES["action_list"] = audit + (
        "\nSELECT dimension, score, round((100 - score) * weight, 1) AS impact FROM scores "
        f"WHERE round((100 - score) * weight, 1) > 0.5 AND dimension IN (SELECT dimension FROM ({listed}) AS l)")
    amounts = [
        ("HIGH", "completeness", "(SELECT round(sum(missing_cells) * 100.0 / sum(n_rows), 4) FROM missing)", 5),
        ("HIGH", "uniqueness", "(SELECT duplicates FROM dup)", 0),
        ("MED", "consistency", issue.format("case"), 0),
        ("HIGH", "validity", "(SELECT count(*) FROM impossible)", 0),
        ("MED", "validity", "(SELECT count(*) FROM outliers WHERE outliers > 0)", 0),
        ("MED", "structure", "(SELECT count(*) FROM textnum)", 0),
        ("LOW", "correlation", "(SELECT count(DISTINCT column_b) FROM pairs WHERE abs(r) > 0.999)", 0),
        ("LOW", "accuracy", "(SELECT count(*) FROM skewed)", 0),
    ]
    advice = ("fill_missing or drop_sparse_columns, or keep a column that marks the gaps",
              "drop_duplicate_rows keeps one of each group",
              "tidy_text makes labels equal that differ in case or padding",
              "impossible_values lists the broken rules; correct them at the source or make them null",
              "outlier_rows shows them; cap_outliers moves them to the fence",
              "Cast the columns that numbers_as_text lists",
              "Keep one of each pair that high_pairs calls perfect",
              "Take a logarithm or ranks of the columns that skewed_columns lists")
    ORACLES["fixes"] = universal + "\nSELECT fix_rank, priority, dimension, amount, advice FROM (" + union([
        f"SELECT {i} AS fix_rank, '{p}' AS priority, '{d}' AS dimension, CAST({x} AS DOUBLE) AS amount, {low} AS low, {text(advice[i - 1])} AS advice"
        for i, (p, d, x, low) in enumerate(amounts, 1)]) + ") AS f WHERE amount > low"


# ------------------------------------------------------------------ cleaning

def clean_parts(name: str, keep: list[str]) -> list[str]:
    """CTEs t2 (no empty rows), t3 (no placeholders), t5 (filled), t6 (distinct), t7 (tidy), t8 (capped)."""
    types = dict(SCHEMAS[name])
    rule = rules.AUDIT
    present = " OR ".join(f"{c} IS NOT NULL" for c in columns(name))
    t3 = ", ".join(f"CASE WHEN {is_holder(c, rule)} THEN NULL ELSE {c} END AS {c}" if kind(types[c]) == STRING else c
                   for c in columns(name))
    fills, tidy = [], []
    for c in keep:
        k = kind(types[c])
        if k == NUMBER:
            median = f"(SELECT {quant(c, .5)} FROM t3)"
            fills.append(f"coalesce(CAST({c} AS DOUBLE), {median}) AS {c}")
        elif k == STRING:
            mode = f"(SELECT {c} FROM t3 WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            fills.append(f"coalesce({c}, {mode}, 'unknown') AS {c}")
        else:
            fills.append(c)
        tidy.append(f"lower({strip(c)}) AS {c}" if k == STRING else c)
    caps, joins = [], []
    for i, c in enumerate(keep):
        if kind(types[c]) == NUMBER:
            joins.append(f"(SELECT {quant(c, .25)} AS q1_{i}, {quant(c, .75)} AS q3_{i} FROM t7) AS e{i}")
            low, high = f"q1_{i} - 3 * (q3_{i} - q1_{i})", f"q3_{i} + 3 * (q3_{i} - q1_{i})"
            caps.append(f"CASE WHEN q3_{i} - q1_{i} > 0 THEN greatest({low}, least({high}, {c})) ELSE {c} END AS {c}")
        else:
            caps.append(c)
    return [f"t2 AS MATERIALIZED (SELECT * FROM t WHERE {present})", f"t3 AS MATERIALIZED (SELECT {t3} FROM t2)",
            f"t5 AS MATERIALIZED (SELECT {', '.join(fills)} FROM t3)", "t6 AS MATERIALIZED (SELECT DISTINCT * FROM t5)",
            f"t7 AS MATERIALIZED (SELECT {', '.join(tidy)} FROM t6)",
            f"t8 AS MATERIALIZED (SELECT {', '.join(caps)} FROM t7, {', '.join(joins)})"]


def typed(name: str, keep: list[str], doubles: set[str]) -> str:
    """Back to the declared types, except for columns that became double."""
    types = dict(SCHEMAS[name])
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in doubles or types[c] == "double"
                     else f"CAST({c} AS {'BIGINT' if types[c] == 'bigint' else 'INTEGER'}) AS {c}" if kind(types[c]) == NUMBER
                     else c for c in keep)


def _cleaning() -> None:
    dirty = columns("dirty_customer")
    round_dirty = typed("dirty_customer", dirty, set())
    ORACLES["clean_names"] = ("SELECT c_custkey AS unnamed_0, c_name AS col_1, c_nationkey AS price, round(c_acctbal, 6) AS a_b, "
                              "c_mktsegment FROM customer")
    present = " OR ".join(f"{c} IS NOT NULL" for c in dirty)
    ORACLES["drop_empty_rows"] = with_table("dirty_customer") + f"\nSELECT {round_dirty} FROM t WHERE {present}"
    kept = [c for c in dirty if c != "sparse_note"]
    ORACLES["drop_sparse_columns"] = (with_table("dirty_customer") + f"\nSELECT {typed('dirty_customer', kept, set())} FROM t")
    parts = clean_parts("dirty_customer", dirty)
    filled = with_table("dirty_customer", "t2 AS (SELECT * FROM t)", *parts[1:3])
    ORACLES["null_placeholders"] = with_table("dirty_customer", "t2 AS (SELECT * FROM t)", parts[1]) + f"\nSELECT {round_dirty} FROM t3"
    ORACLES["fill_missing"] = filled + f"\nSELECT {typed('dirty_customer', dirty, set(columns('dirty_customer', NUMBER)))} FROM t5"
    ORACLES["drop_duplicate_rows"] = with_table("dirty_customer") + f"\nSELECT DISTINCT {round_dirty} FROM t"
    tidy = ", ".join(f"lower({strip(c)}) AS {c}" if t == "string" else f"round({c}, 6) AS {c}" if t == "double" else c
                     for c, t in SCHEMAS["dirty_customer"])
    ORACLES["tidy_text"] = with_table("dirty_customer") + f"\nSELECT {tidy} FROM t"
    events = columns("events")
    cap = clean_parts("events", events)[-1].replace("FROM t7", "FROM t")
    ORACLES["cap_outliers"] = with_table("events", cap) + f"\nSELECT {typed('events', events, set())} FROM t8"
    ORACLES["clean_events"] = with_table("events", *clean_parts("events", events)) + f"\nSELECT {typed('events', events, set())} FROM t8"
    cleaned = with_table("dirty_customer", *clean_parts("dirty_customer", kept))
    final = typed("dirty_customer", kept, set())
    ORACLES["clean_full"] = cleaned + f"\nSELECT {final} FROM t8"
    ORACLES["clean_preview"] = cleaned + f"\nSELECT {final} FROM t8 ORDER BY cust_id LIMIT 20"
    names = {"rows": "n_rows", "columns": "n_columns", "missing_cells": "null_cells", "score": "score"}
    ORACLES["before_after"] = with_table(
        "dirty_customer", *clean_parts("dirty_customer", kept), f"b AS ({quick_select('t', dirty, 1.03)})",
        f"a AS ({quick_select('t8', kept, 1.03)})") + "\n" + union([
            f"SELECT '{m}' AS metric, CAST(b.{c} AS DOUBLE) AS before, CAST(a.{c} AS DOUBLE) AS after, "
            f"round(CAST(a.{c} AS DOUBLE) - b.{c}, 6) AS delta FROM a, b" for m, c in names.items()])


def _sources() -> None:
    ORACLES["csv_orders"] = ("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
                             "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate, o_orderpriority FROM orders")
    nulls = ", ".join(f"CASE WHEN {c} IN {words(NULLS)} THEN NULL ELSE {c} END AS {c}"
                      for c in columns("dirty_customer", STRING))
    read = typed("dirty_customer", columns("dirty_customer"), set()).replace("CAST(age AS INTEGER)", "CAST(age AS BIGINT)")
    read = read.replace("CAST(birth_month AS INTEGER)", "CAST(birth_month AS BIGINT)").replace(
        " nation_text", " CAST(nation_text AS BIGINT) AS nation_text")
    ORACLES["csv_dirty_customer"] = with_table("dirty_customer", f"n AS (SELECT * REPLACE ({nulls}) FROM t)") + f"\nSELECT {read} FROM n"


def _layouts() -> None:
    texts = {"zoned": "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'", "shifted": "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'",
             "minutes": "strftime(ts, '%Y-%m-%d %H:%M')", "fraction": "strftime(ts, '%Y-%m-%d %H:%M:%S') || '.25'",
             "written": "strftime(ts, '%-d %b %Y %H:%M')", "unpadded": "strftime(ts, '%-m/%-d/%Y')",
             "compact": "strftime(ts, '%Y%m%d')", "month": "strftime(ts, '%b %Y')", "clock": "strftime(ts, '%-m/%-d/%Y %-I:%M %p')"}
    table = "WITH t AS MATERIALIZED (SELECT " + ", ".join(f"{v} AS {k}" for k, v in texts.items()) + " FROM events)\n"
    ORACLES["date_layouts"] = table + union([f"SELECT '{c}' AS \"column\", round({date_share(c)}, 6) AS date_share FROM t" for c in texts])
    branches = []
    for c in texts:
        best = " UNION ALL ".join(f"SELECT count({parsed(c, i)}) AS k, {i} AS o, " + count_if(f"{parsed(c, i)} > TIMESTAMP '{AS_OF}'")
                                  + " AS f FROM t" for i in range(len(DUCK_FORMATS)))
        branches.append(f"SELECT '{c}' AS \"column\", f AS future_dates FROM ({best} ORDER BY k DESC, o LIMIT 1) AS b")
    ORACLES["future_dates_layouts"] = table + f"SELECT * FROM ({union(branches)}) AS f WHERE future_dates > 0"


def _more() -> None:
    ORACLES["box_stats_by_role"] = (f"SELECT b.* FROM ({ORACLES['box_stats']}) AS b SEMI JOIN ({with_table('lineitem')} "
                                    f"{roles('lineitem')}) AS r ON b.\"column\" = r.\"column\" AND r.tag = 'numeric'")
    names = ["balance_amount", "age", "bal_a", "bal_b", "older"]
    table = f"WITH t AS MATERIALIZED (SELECT balance_amount, age, bal_a, bal_b, CAST(age > 40 AS INTEGER) AS older FROM {source('dirty_customer')} AS s)\n"
    ORACLES["corr_by_role"] = table + union([
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {'CAST(any_value(1) AS DOUBLE)' if a == b else f'round({corr(a, b)}, 6)'} AS r FROM t"
        for a in names for b in names])
    ORACLES["worst_outliers"] = f"SELECT * FROM ({ORACLES['outlier_columns']}) AS o ORDER BY outlier_pct DESC, \"column\" LIMIT 6"
    null = lambda c: f"CASE WHEN {c} NOT IN {words(NULLS)} THEN {c} END AS {c}"
    ORACLES["csv_documents"] = f"SELECT doc_id, {null('text')}, {null('lang')}, {null('source')}, n_chars FROM documents"
    ORACLES["csv_latin1"] = (f"SELECT doc_id, {null('text')} FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x{{FF}}]', '?', 'g') AS text "
                             "FROM documents) AS d")
    ORACLES["csv_replacement_character"] = "SELECT c_custkey, 'caf\u00e9 \ufffd ' || c_name AS c_name FROM customer"
    ORACLES["csv_export"] = ("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier")
    ORACLES["report_csv"] = ORACLES["score_report"]
    ORACLES["clean_nested"] = "SELECT DISTINCT o_orderkey % 100 AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
    table = "WITH t AS MATERIALIZED (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)\n"
    ORACLES["describe_nan"] = table + union([
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round({quant(c, .25)}, 6) AS q25, round({quant(c, .5)}, 6) AS q50, "
        f"round({quant(c, .75)}, 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM t" for c in ("event_id", "value")])
    ORACLES["classify_nan"] = table + union([
        f"SELECT '{c}' AS \"column\", '{tag}' AS tag, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, "
        f"count(DISTINCT {c}) AS n_distinct FROM t" for c, tag in (("event_id", "id"), ("value", "numeric"))])


for _build in (_profile, _classifier, _explorer, _detectors, _scores, _cleaning, _sources, _layouts, _more):
    _build()

from catalog import features_sql  # noqa: E402, F401  (adds its SQL)
