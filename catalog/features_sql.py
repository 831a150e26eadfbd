"""SQL for the queries of ``catalog.features``."""

from __future__ import annotations

from catalog.oracles import NUMBER, ORACLES, SCHEMAS, columns, roles, union, with_table

ORDERS = [("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"), ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "number"),
          ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "string")]
CHANGED = [("o_orderkey", "int", "number"), ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "number"),
           ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "int", "number"), ("is_even", "boolean", "boolean")]
EVENTS = [("event_id", "bigint", "number"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "number"), ("value", "double", "number"), ("props", "string", "string")]

CHANGED_SQL = """SELECT CAST(o_orderkey AS INT) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 1.5::DOUBLE END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS o_orderdate,
  CAST(o_orderkey % 7 AS INT) AS o_orderpriority, o_orderkey % 2 = 0 AS is_even FROM orders WHERE o_orderkey % 3 = 0"""


def _summary(source: str, table: str, columns) -> str:
    """Counts per bin: numbers to 11 binary digits, times by month, texts by three digits of their MD5."""
    branches = []
    for name, dtype, kind in columns:
        place = label = "NULL"
        if kind == "number":
            x = f"CAST({name} AS DOUBLE)"
            place = f"({x} * 4398046511105::DOUBLE) - (({x} * 4398046511105::DOUBLE) - {x})"
        elif kind == "datetime":
            place = f"CAST(year({name}) * 12 + month({name}) - 1 AS DOUBLE)"
        elif kind == "boolean":
            label = f"CAST({name} AS VARCHAR)"
        else:
            label = f"substr(md5({name}), 1, 3)"
        branches.append(f"SELECT {source} AS source, '{name}' AS col, '{dtype}' AS dtype, '{kind}' AS kind, CAST({place} AS DOUBLE) AS place, "
                        f"CAST({label} AS VARCHAR) AS bin FROM {table}")
    return "\nUNION ALL\n".join(branches)


_COMPARE = """WITH cells AS MATERIALIZED (SUMMARY),
tot AS (SELECT source, col, dtype, kind, count(*) AS n, count(place) + count(bin) AS filled FROM cells GROUP BY ALL),
own AS (SELECT * FROM tot WHERE source = 'BASE'), oth AS (SELECT * FROM tot WHERE source <> 'BASE'),
want AS (SELECT DISTINCT oth.source, own.col FROM oth, own UNION SELECT source, col FROM oth),
pair AS (SELECT oth.source, oth.col, oth.kind, own.filled AS bf, oth.filled AS f FROM oth JOIN own USING (col, kind) WHERE own.filled > 0 AND oth.filled > 0),
bins AS (SELECT source, col, place, bin, count(*) AS n FROM cells WHERE place IS NOT NULL OR bin IS NOT NULL GROUP BY ALL),
keyed AS (SELECT p.source, p.col, p.kind, bf, f, b.place, b.bin FROM pair p JOIN bins b ON b.col = p.col AND b.source = 'BASE'
  UNION SELECT p.source, p.col, p.kind, bf, f, b.place, b.bin FROM pair p JOIN bins b ON b.col = p.col AND b.source = p.source),
both_ AS (SELECT k.*, coalesce(x.n, 0) AS bn, coalesce(y.n, 0) AS o FROM keyed k
  LEFT JOIN bins x ON x.source = 'BASE' AND x.col = k.col AND x.place IS NOT DISTINCT FROM k.place AND x.bin IS NOT DISTINCT FROM k.bin
  LEFT JOIN bins y ON y.source = k.source AND y.col = k.col AND y.place IS NOT DISTINCT FROM k.place AND y.bin IS NOT DISTINCT FROM k.bin),
cum AS (SELECT *, sum(bn) OVER w AS bb, sum(o) OVER w AS ob FROM both_ WHERE kind IN ('number', 'datetime')
  WINDOW w AS (PARTITION BY source, col ORDER BY place)),
parts AS (SELECT source, col, bf, f, CAST(least(9, floor((bb - bn) * 10 / bf)) AS VARCHAR) AS part, sum(bn) AS bn, sum(o) AS o,
    max(abs(bb / bf - ob / f)) AS gap, true AS ordered FROM cum GROUP BY ALL
  UNION ALL SELECT source, col, bf, f, bin, bn, o, abs(bn / bf - o / f) / 2, false FROM both_ WHERE kind NOT IN ('number', 'datetime')),
shares AS (SELECT *, (bn + 0.5::DOUBLE) / (bf + 0.5::DOUBLE * count(*) OVER w) AS p, (o + 0.5::DOUBLE) / (f + 0.5::DOUBLE * count(*) OVER w) AS q FROM parts
  WINDOW w AS (PARTITION BY source, col)),
drift AS (SELECT source, col, sum((p - q) * ln(p / q)) AS psi, CASE WHEN ordered THEN max(gap) ELSE sum(gap) END AS distance FROM shares GROUP BY source, col, ordered)
SELECT w.source, w.col AS column, CASE WHEN y.dtype IS NULL THEN 'missing' WHEN x.dtype IS NULL THEN 'added' WHEN x.kind <> y.kind THEN 'other kind'
    WHEN x.dtype <> y.dtype THEN 'other type' ELSE 'same' END AS schema, x.dtype AS base_dtype, y.dtype AS dtype, x.n AS base_rows, y.n AS rows,
  round(1 - x.filled / x.n, 6) AS base_null_share, round(1 - y.filled / y.n, 6) AS null_share, round(psi, 6) AS psi, round(distance, 6) AS distance,
  CASE WHEN psi >= 0.25 THEN 'drifted' WHEN psi >= 0.1 THEN 'shifted' WHEN psi IS NOT NULL THEN 'stable' END AS level
FROM want w LEFT JOIN own x ON x.col = w.col LEFT JOIN oth y ON y.source = w.source AND y.col = w.col LEFT JOIN drift d ON d.source = w.source AND d.col = w.col"""

ORACLES["compare_tables"] = _COMPARE.replace("BASE", "base").replace(
    "SUMMARY", _summary("'base'", "orders", ORDERS) + "\nUNION ALL\n" + _summary("'changed'", f"({CHANGED_SQL}) AS c", CHANGED))
ORACLES["compare_sources"] = _COMPARE.replace("BASE", "click").replace("SUMMARY", _summary("event_type", "events", EVENTS))

ORACLES["read_several_files"] = f"""
SELECT 'first' AS source, count(*) AS n, count(o_custkey) AS customers, CAST(0 AS BIGINT) AS evens, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders
UNION ALL SELECT 'second', count(*), 0, count(is_even), CAST(sum(o_orderkey) AS BIGINT) FROM ({CHANGED_SQL}) AS c"""

_STATUS, _URGENT = "o_orderstatus IN ('F', 'O')", "(o_totalprice < 300000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))"
_CONDITIONS = [("positive price", "error", "o_totalprice > 0"), ("known status", "error", _STATUS), ("dear orders are urgent", "warning", _URGENT),
               ("key or customer", "error", "(o_orderkey % 1000 <> 0 OR o_custkey > 100)"), ("dated", "error", "o_orderdate >= TIMESTAMP '1993-01-01'")]


def _rule_row(position: int, name: str, kind: str, severity: str, checked: str, broken: str, table: str) -> str:
    return (f"SELECT {position} AS position, '{name}' AS rule, '{kind}' AS kind, '{severity}' AS severity, CAST({checked} AS BIGINT) AS checked, "
            f"CAST({broken} AS BIGINT) AS broken, round(coalesce({broken} / nullif({checked}, 0)::DOUBLE, 0), 6) AS broken_share, {broken} = 0 AS passed FROM {table}")


def _values(columns: str, decides: str) -> str:
    return f"(SELECT {columns}, {decides} AS v, count(*) AS n FROM orders GROUP BY ALL)"


ORACLES["custom_rules"] = "\nUNION ALL\n".join(
    [_rule_row(n, name, "row", severity, f"count({test})", f"count(*) FILTER (WHERE NOT {test})", "orders") for n, (name, severity, test) in enumerate(_CONDITIONS)]
    + [_rule_row(5 + n, name, "reference", "error", "count(o_custkey)", f"count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer{where}))", "orders")
       for n, (name, where) in enumerate((("known customer", ""), ("customer in a low nation", " WHERE c_nationkey < 12")))]
    + [_rule_row(7 + n, name, "dependency", "warning", "sum(n)", "sum(n - most)",
                 f"(SELECT sum(n) AS n, max(n) AS most FROM {_values(key, decides)} AS x GROUP BY {key}) AS g")
       for n, (name, key, decides) in enumerate((("customer decides priority", "o_custkey", "o_orderpriority"), ("key decides all", "o_orderkey", "o_totalprice")))])

ORACLES["rule_broken_rows"] = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority, broken_rules FROM (
  SELECT *, concat_ws('; ', """ + ", ".join(f"CASE WHEN NOT {test} THEN '{name}' END" for name, _, test in _CONDITIONS) + """) AS broken_rules FROM orders) WHERE broken_rules <> ''"""
ORACLES["rule_fixes"] = f"""SELECT o_orderkey, o_custkey, CASE WHEN NOT {_STATUS} THEN '?' ELSE o_orderstatus END AS o_orderstatus,
  round(CASE WHEN NOT {_URGENT} THEN 300000 ELSE o_totalprice END, 6) AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 0 OR o_totalprice IS NULL"""

ORACLES["broken_references"] = """SELECT l_partkey, count(*) AS rows FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY l_partkey"""
_FLAGS = "SELECT l_shipdate, l_linenumber, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL"
ORACLES["dependencies"] = f"""SELECT l_shipdate, l_linenumber, CAST(sum(n) AS BIGINT) AS rows, count(*) AS values, CAST(sum(n) - max(n) AS BIGINT) AS broken
FROM ({_FLAGS}) GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["dependency_rows"] = f"""WITH best AS (SELECT l_shipdate, l_linenumber, v FROM ({_FLAGS}) QUALIFY row_number() OVER (PARTITION BY l_shipdate, l_linenumber ORDER BY n DESC, v) = 1)
SELECT l.* REPLACE (round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax)
FROM lineitem l JOIN best b ON l.l_shipdate IS NOT DISTINCT FROM b.l_shipdate AND l.l_linenumber IS NOT DISTINCT FROM b.l_linenumber
WHERE l.l_returnflag IS DISTINCT FROM b.v"""

_MISSPELT = """m AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 17 = 0 THEN ' ' || c_mktsegment
  WHEN c_custkey % 19 = 0 THEN c_mktsegment[1:3] || c_mktsegment[5:] WHEN c_custkey % 23 = 0 THEN c_mktsegment[1:4] || 'x' || c_mktsegment[5:]
  WHEN c_custkey % 29 = 0 THEN c_mktsegment[1:2] || '_' || c_mktsegment[4:] ELSE c_mktsegment END AS segment FROM customer),
counts AS (SELECT col, label, count(*) AS n, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS form
  FROM (SELECT 'segment' AS col, segment AS label FROM m UNION ALL SELECT 'c_name', c_name FROM m) WHERE label IS NOT NULL GROUP BY ALL),
forms AS (SELECT DISTINCT col, form FROM counts),
near AS (SELECT x.col, x.form AS a, y.form AS b FROM forms x JOIN forms y ON x.col = y.col AND x.form <> y.form AND levenshtein(x.form, y.form) <= 1
  AND length(x.form) BETWEEN 5 AND 64 AND length(y.form) BETWEEN 5 AND 64 AND NOT regexp_matches(x.form, '[0-9]') AND NOT regexp_matches(y.form, '[0-9]')
  WHERE x.col = 'segment'),
reach AS (SELECT col, form, form AS root FROM forms UNION SELECT r.col, n.b, r.root FROM reach r JOIN near n ON n.col = r.col AND n.a = r.form),
rooted AS (SELECT col, form, min(root) AS root FROM reach GROUP BY ALL),
every AS (SELECT c.*, root FROM counts c JOIN rooted USING (col, form)),
named AS (SELECT col, label, n, first_value(label) OVER (PARTITION BY col, root ORDER BY n DESC, label) AS unified FROM every)"""
ORACLES["label_spellings"] = f"WITH RECURSIVE {_MISSPELT} SELECT col AS column, label, n, unified FROM named"
ORACLES["unified_labels"] = f"""WITH RECURSIVE {_MISSPELT}
SELECT c_custkey, unified AS segment, c_name FROM m LEFT JOIN named ON named.col = 'segment' AND named.label = m.segment"""

ORACLES["target_encoding"] = """WITH t AS (SELECT *, ('0x' || md5(CAST(o_orderkey AS VARCHAR))[1:7])::BIGINT % 5 AS fold FROM orders),
c AS (SELECT o_orderpriority AS p, fold, sum(o_totalprice) AS s, count(o_totalprice) AS n FROM t GROUP BY ALL),
g AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS mean FROM (SELECT fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY fold)),
e AS (SELECT p, fold, (sum(s) OVER w - s + 20 * mean) / (sum(n) OVER w - n + 20) AS v FROM c JOIN g USING (fold) WINDOW w AS (PARTITION BY p))
SELECT o_orderkey, o_orderpriority, round(v, 6) AS o_orderpriority_target FROM t JOIN e ON e.fold = t.fold AND e.p IS NOT DISTINCT FROM o_orderpriority"""

_FITTED = "WITH f AS (SELECT *, c_mktsegment AS segment FROM customer WHERE c_nationkey < 12)"
_SCALES = {"standard": ("avg({c})", "stddev_samp({c})"), "span": ("min({c})", "max({c}) - min({c})"),
           "robust": ("quantile_cont(CAST({c} AS DOUBLE), 0.5)", "quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)")}
ORACLES["scaled"] = _FITTED + " SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, " + ", ".join(
    f"round(({c} - (SELECT {a.format(c=c)} FROM f)) / (SELECT {b.format(c=c)} FROM f), 6) AS {c}_{step}"
    for c in ("c_acctbal", "c_nationkey") for step, (a, b) in _SCALES.items()) + " FROM customer"

_LABELS = _MISSPELT[:_MISSPELT.index("counts AS")].rstrip().rstrip(",")
ORACLES["one_hot"] = f"""{_FITTED}, k AS (SELECT segment, row_number() OVER (ORDER BY count(*) DESC, segment) AS r FROM f GROUP BY segment QUALIFY r <= 3), {_LABELS}
SELECT c_custkey, """ + ", ".join(f"CAST(k.r IS NOT NULL AND k.r = {n} AS INTEGER) AS segment_{n}" for n in (1, 2, 3)) + """,
  CAST(m.segment IS NOT NULL AND k.r IS NULL AS INTEGER) AS segment_other, CAST(m.segment IS NULL AS INTEGER) AS segment_null FROM m LEFT JOIN k ON k.segment = m.segment"""
ORACLES["frequency_encoded"] = f"""{_FITTED}, k AS (SELECT segment, count(*) / sum(count(*)) OVER () AS share FROM f GROUP BY segment), {_LABELS}
SELECT c_custkey, m.segment, round(coalesce(share, 0), 6)::DOUBLE AS segment_frequency FROM m LEFT JOIN k ON k.segment = m.segment"""
ORACLES["target_fitted"] = f"""{_FITTED}, o AS (SELECT avg(c_acctbal) AS mean FROM f),
k AS (SELECT segment, (sum(c_acctbal) + 20 * any_value(mean)) / (count(*) + 20) AS v FROM f, o GROUP BY segment), {_LABELS}
SELECT c_custkey, m.segment, round(coalesce(v, mean), 6) AS segment_target FROM m LEFT JOIN k ON k.segment = m.segment, o"""

_TERMS = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, count(*) AS df, row_number() OVER (ORDER BY term) - 1 AS index FROM tf GROUP BY term)"""
ORACLES["tfidf_vocabulary"] = f"WITH {_TERMS} SELECT * FROM v"
ORACLES["tfidf_documents"] = f"""WITH {_TERMS}, w AS (SELECT doc_id, index, tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT doc_id) FROM t)) / (df + 1)) + 1) AS w FROM tf JOIN v USING (term))
SELECT doc_id, index, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""

_TEXTS = """t AS (SELECT c_custkey, c_name, CASE c_custkey % 7 WHEN 0 THEN '1,234.50' WHEN 1 THEN ' ' || c_custkey || ' ' WHEN 2 THEN '12.0' WHEN 3 THEN '99999999999999999999'
    WHEN 4 THEN 'about 5' WHEN 5 THEN '' ELSE '3.25' END AS amount,
  CASE c_custkey % 9 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '31/12/2020' WHEN 3 THEN '20240120' WHEN 4 THEN 'Jan 2024' WHEN 5 THEN '7 Mar 2021'
    WHEN 6 THEN '05/06/2022 03:15 PM' WHEN 7 THEN 'soon' END AS day,
  CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END AS flag FROM customer)"""
ORACLES["converted"] = f"""WITH {_TEXTS} SELECT c_custkey, c_name, try_cast(replace(trim(amount), ',', '') AS DOUBLE) AS amount,
  coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%Y%m%d'), try_strptime(day, '%d %b %Y'), try_strptime(day, '%b %Y'),
    try_strptime(day, '%d/%m/%Y %I:%M %p')) AS day,
  CASE WHEN lower(flag) IN ('yes', '1') THEN true WHEN lower(flag) = 'false' THEN false END AS flag,
  CASE WHEN amount = '12.0' THEN 12 WHEN c_custkey % 7 = 1 THEN c_custkey END AS whole FROM t"""
ORACLES["rejected_cells"] = f"""WITH {_TEXTS} SELECT c_custkey AS key, 'amount' AS column, amount AS value, 'not a number' AS reason FROM t WHERE amount = 'about 5'
UNION ALL SELECT c_custkey, 'whole', amount, CASE amount WHEN 'about 5' THEN 'not a number' WHEN '99999999999999999999' THEN 'out of range' ELSE 'has a fraction' END
  FROM t WHERE c_custkey % 7 IN (0, 3, 4, 6)
UNION ALL SELECT c_custkey, 'day', day, 'not a time' FROM t WHERE day IN ('2023-02-29', 'soon') UNION ALL SELECT c_custkey, 'flag', flag, 'not a truth value' FROM t WHERE flag = 'maybe'"""

_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"
ORACLES["repaired_text"] = f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{_BLANK}', ' ', 'g')) AS text FROM documents"


def _suggested(position: int, c: str) -> str:
    cell = f"trim({c})"
    time = f"coalesce(try_strptime({cell}, '%Y-%m-%d'), try_strptime({cell}, '%d/%m/%Y')) IS NOT NULL"
    tests = {"filled": f"{cell} <> ''", "whole": f"regexp_matches({cell}, '^[+-]?[0-9]+$')", "number": f"try_cast({cell} AS DOUBLE) IS NOT NULL",
             "truth": f"lower({cell}) IN ('true', 'yes', 'y', '1', 'false', 'no', 'n', '0')", "time": time}
    counts = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in tests.items())
    levels = " ".join(f"WHEN {name} >= 0.95 * filled THEN '{kind}'" for kind, name in (("boolean", "truth"), ("bigint", "whole"), ("double", "number"), ("timestamp", "time")))
    return (f"SELECT *, CASE WHEN filled = 0 THEN 'string' {levels} ELSE 'string' END AS suggested FROM "
            f"(SELECT CAST({position} AS INTEGER) AS position, '{c}' AS column, {counts} FROM t)")


ORACLES["suggested_types"] = with_table("dirty_customer") + "\n" + union(
    [_suggested(n, c) for n, (c, t) in enumerate(SCHEMAS["dirty_customer"]) if t == "string"])

_LINES = "e AS (SELECT * FROM events WHERE event_id % 50 <> 7), s AS (SELECT event_id, unnest(range(1, event_id % 3 + 2)) AS rank FROM e)"
_HITS = "h AS (SELECT event_id, rank, unnest(range(1, rank + 1)) AS y FROM s)"
ORACLES["json_events"] = """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", round(value, 6) AS "detail.amount", user_id AS "detail.user.id"
FROM events WHERE event_id % 50 <> 7"""
ORACLES["json_nested"] = f"""WITH {_LINES}, {_HITS}
SELECT event_id, CAST(rank - 1 AS INTEGER) AS position, CAST(y - 1 AS INTEGER) AS position2, rank, y * event_id AS value FROM h"""
ORACLES["json_report"] = f"""WITH {_LINES}, {_HITS} SELECT 'rows' AS "table", count(*) AS n FROM e UNION ALL SELECT 'steps', count(*) FROM s
UNION ALL SELECT 'steps.hits', count(*) FROM h UNION ALL SELECT 'bad lines', count(*) FROM events WHERE event_id % 50 = 7"""
ORACLES["json_bad_lines"] = """SELECT substr('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props', 1, 30) AS line FROM events WHERE event_id % 50 = 7"""

ORACLES["numeric_summary_by_role"] = (f"SELECT b.* FROM ({ORACLES['numeric_summary']}) AS b SEMI JOIN ({with_table('lineitem')} "
                                      f"{roles('lineitem')}) AS r ON b.\"column\" = r.\"column\" AND r.tag = 'numeric'")
ORACLES["histogram_infinite"] = """WITH t AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE ELSE value END AS v FROM events),
e AS (SELECT min(v) AS lo, max(v) AS hi, CAST(least(50, count(DISTINCT v)) AS INTEGER) AS nb FROM t WHERE isfinite(v))
SELECT 'value' AS "column", bin, round(lo + (hi - lo) / nb * (bin - 1), 6) AS low, round(lo + (hi - lo) / nb * bin, 6) AS high, count(*) AS n
  FROM (SELECT CAST(least(CAST(floor(nb * (v - lo) / (hi - lo)) AS INTEGER) + 1, nb) AS INTEGER) AS bin, lo, hi, nb FROM t, e WHERE isfinite(v)) GROUP BY bin, lo, hi, nb
UNION ALL SELECT 'value', CASE WHEN v > 0 THEN nb + 1 ELSE 0 END, v, v, count(*) FROM t, e WHERE isinf(v) GROUP BY ALL
UNION ALL SELECT 'only', 1, 'inf'::DOUBLE, 'inf'::DOUBLE, count(*) FROM t"""

_DIRTY = [c for c, _ in SCHEMAS["dirty_customer"]]
_CELLS = " + ".join(f"count({c})" for c in columns("dirty_customer", NUMBER))
_LOSSES = f"""{with_table('dirty_customer')},
miss AS ({ORACLES['missing_by_column_audit']}), dup AS ({ORACLES['duplicate_rows']}), cons AS ({ORACLES['constant_columns']}), same AS ({ORACLES['identical_columns']}),
forms AS ({ORACLES['consistency_issues_audit']}), outs AS ({ORACLES['outlier_columns']}), bad AS ({ORACLES['impossible_values_audit']}),
skewed AS ({ORACLES['skewed_columns_audit']}), noise AS ({ORACLES['label_noise']}), texts AS ({ORACLES['numbers_as_text']}), strong AS ({ORACLES['corr_pairs']}),
score AS ({ORACLES['dqs_audit']}),
alone(dimension, cause, v) AS (
  SELECT 'completeness', 'missing cells', CAST(1 AS DOUBLE) UNION ALL SELECT 'uniqueness', 'duplicate rows', (SELECT least(150.0 * duplicate_rows / n_rows, 60) FROM dup)
  UNION ALL SELECT 'uniqueness', 'constant columns', (SELECT least(5 * count(*), 30) FROM cons) UNION ALL SELECT 'uniqueness', 'identical columns', (SELECT least(8 * count(*), 30) FROM same)
  UNION ALL SELECT 'consistency', 'mixed forms', 1 UNION ALL SELECT 'validity', 'outliers', (SELECT 80.0 * sum(outliers) / (SELECT {_CELLS} FROM t) FROM outs)
  UNION ALL SELECT 'validity', 'impossible values', (SELECT least(10 * count(*), 40) FROM bad) UNION ALL SELECT 'accuracy', 'skew', (SELECT least(4 * count(*), 30) FROM skewed)
  UNION ALL SELECT 'accuracy', 'noisy labels', (SELECT least(8 * sum(noisy_labels), 40) FROM noise) UNION ALL SELECT 'structure', 'names and number texts', 1
  UNION ALL SELECT 'correlation', 'correlated pairs', 1),
blame(dimension, cause, col, amount) AS (
  SELECT 'completeness', 'missing cells', "column", CAST(missing_cells AS DOUBLE) FROM miss UNION ALL SELECT 'uniqueness', 'duplicate rows', NULL, 1
  UNION ALL SELECT 'uniqueness', 'constant columns', "column", 1 FROM cons UNION ALL SELECT 'uniqueness', 'identical columns', unnest([column_a, column_b]), 0.5 FROM same
  UNION ALL SELECT 'consistency', 'mixed forms', "column", 1 FROM forms UNION ALL SELECT 'validity', 'outliers', "column", outliers FROM outs
  UNION ALL SELECT 'validity', 'impossible values', "column", 1 FROM bad UNION ALL SELECT 'accuracy', 'skew', "column", 1 FROM skewed
  UNION ALL SELECT 'accuracy', 'noisy labels', "column", noisy_labels FROM noise UNION ALL SELECT 'structure', 'names and number texts', "column", 1 FROM texts
  UNION ALL SELECT 'correlation', 'correlated pairs', unnest([column_a, column_b]), 0.5 FROM strong),
summed AS (SELECT dimension, cause, col, sum(amount) AS amount FROM blame GROUP BY ALL HAVING sum(amount) > 0),
part AS (SELECT dimension, cause, v / sum(v) OVER (PARTITION BY dimension) AS share FROM alone WHERE v > 0),
names AS (SELECT unnest({_DIRTY}) AS col, unnest(range(0, {len(_DIRTY)})) AS position),
losses AS (SELECT CAST(position AS INTEGER) AS position, s.col, s.dimension, s.cause, amount / sum(amount) OVER (PARTITION BY s.dimension, s.cause) * share * (100 - score) AS loss, weight
  FROM summed s JOIN part USING (dimension, cause) JOIN score ON score.dimension = s.dimension LEFT JOIN names USING (col) WHERE score < 100)
"""
ORACLES["column_losses"] = _LOSSES + """SELECT position, col AS "column", dimension, cause, round(loss, 6)::DOUBLE AS loss, round(loss * weight, 6)::DOUBLE AS points FROM losses"""
ORACLES["column_scores"] = _LOSSES + f""", per AS (SELECT position, col, dimension, sum(loss * weight) AS points FROM losses GROUP BY ALL),
each AS (SELECT position, col, sum(points) AS points, max_by(dimension, (points, dimension)) AS worst FROM per GROUP BY ALL)
SELECT CAST(n.position AS INTEGER) AS position, n.col AS "column", round(coalesce(points, 0), 6)::DOUBLE AS points, round(greatest(0, 100 - coalesce(points, 0) * {len(_DIRTY)}), 6)::DOUBLE AS score,
  worst AS worst_dimension FROM names n LEFT JOIN each ON each.col = n.col
UNION ALL SELECT position, col, round(points, 6)::DOUBLE, NULL, worst FROM each WHERE col IS NULL"""
ORACLES["column_losses_sum"] = f"""SELECT dimension, score, CASE WHEN score < 100 THEN round(100 - score, 6)::DOUBLE END AS loss,
  CASE WHEN score < 100 THEN round((100 - score) * weight, 6)::DOUBLE END AS points FROM ({ORACLES['dqs_audit']})"""

ORACLES["rejected_files"] = """SELECT 'rows beyond the header' AS file, 'the CSV can''t be parsed: a row has more fields than the header' AS outcome, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'no rows', 'the table is empty: no rows found', 0 UNION ALL SELECT 'blank', 'no columns: the file is blank or not formatted as a table', 0
UNION ALL SELECT 'good', 'read', (SELECT count(*) FROM region)"""
