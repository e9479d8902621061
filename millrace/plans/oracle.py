"""SQL equivalents of the registered queries, for an independent engine."""

from __future__ import annotations

from millrace.functions.text import BLANKS
from millrace.operators.logs import CODE_PATTERNS, INJECTION_PATTERNS
from millrace.plans.views import plain

ORACLE: dict[str, str] = {}

N, T, B, D, O = "numeric", "text", "boolean", "datetime", "other"

# Column names and kinds of the views, in order.
SHAPES = {
    "dirty_events": {
        "event_id": N, "user_id": N, "ts": D, "amount": N, "rare_amount": N, "event_type": T, "spiky": N, "release": T,
        "channel": T, "user_text": T, "day_text": T, "padded_type": T, "email": T,
    },
    "repeated_events": {"user_id": N, "event_type": T, "day_text": T},
    "repeated_lines": {"l_returnflag": T, "l_linestatus": T, "l_linenumber": N, "l_quantity": N, "discount": N},
    "lineitem": {
        "l_orderkey": N, "l_partkey": N, "l_suppkey": N, "l_linenumber": N, "l_quantity": N, "l_extendedprice": N,
        "l_discount": N, "l_tax": N, "l_returnflag": T, "l_linestatus": T, "l_shipdate": D,
    },
    "documents": {"doc_id": N, "text": T, "lang": T, "source": T, "n_chars": N},
    "order_texts": {
        "o_orderkey": N, "o_totalprice": N, "customer_text": T, "mostly_number": T, "partly_number": T, "mostly_date": T,
        "us_date": T,
    },
    "dated_orders": {
        "o_orderkey": N, "day_first": T, "month_first": T, "dotted": T, "with_time": T, "mostly_day_first": T, "either_order": T,
    },
    "sparse_orders": {
        "o_orderkey": N, "empty_note": T, "rare_price": N, "fixed": T, "price": N, "priority": T, "padded_status": T,
        "customer_text": T, "date_text": T,
    },
    "orders": {
        "o_orderkey": N, "o_custkey": N, "o_orderstatus": T, "o_totalprice": N, "o_orderdate": D, "o_orderpriority": T,
    },
    "events": {"event_id": N, "ts": D, "user_id": N, "event_type": T, "value": N, "props": T},
}


def of(view: str, body: str) -> str:
    """A query over ``t``, the named view."""
    return f"WITH t AS ({plain(view)})\n{body}"


def rest(view: str, **changed: str) -> str:
    """All columns of a view, with some replaced."""
    return ", ".join(f'{changed[c]} AS "{c}"' if c in changed else f'"{c}"' for c in SHAPES[view])


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round({part} * 100.0::DOUBLE / {whole}, {digits})"


BLANK_TEXT = BLANKS.replace("'", "''")


def stripped(column: str) -> str:
    return f"trim({column}, '{BLANK_TEXT}')"


EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PARSED_DATE = (
    "coalesce(CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} AS TIMESTAMP) END, "
    "try_strptime({c}, [{layouts}]))"
)
SEPARATED = [f"{{0}}{mark}{{1}}{mark}%Y{time}" for mark in "/.-" for time in ("", " %H:%M")]


def parsed_date(column: str, *order: str) -> str:
    layouts = ", ".join(f"'{layout.format(*(order or ('%m', '%d')))}'" for layout in SEPARATED)
    return PARSED_DATE.format(c=column, layouts=layouts)


# -- column facts -----------------------------------------------------------


def column_facts(view: str, names: dict[str, str] | None = None) -> str:
    """Named subqueries: ``t``, ``facts`` (a row per column) and ``dup`` (one row)."""
    names = names or {}
    rows, outliers = [], []
    for i, (c, kind) in enumerate(SHAPES[view].items()):
        numeric, text = kind == N, kind == T
        value = f"CAST({c} AS DOUBLE)"
        figures = {
            "n_distinct": f"count(DISTINCT {c})" if text else "NULL::BIGINT",
            "q1": f"quantile_cont({value}, 0.25)" if numeric else "NULL::DOUBLE",
            "median": f"quantile_cont({value}, 0.5)" if numeric else "NULL::DOUBLE",
            "q3": f"quantile_cont({value}, 0.75)" if numeric else "NULL::DOUBLE",
            "mean": f"avg({value})" if numeric else "NULL::DOUBLE",
            "std": f"stddev_samp({value})" if numeric else "NULL::DOUBLE",
            "low": f"min({value})" if numeric else "NULL::DOUBLE",
            "high": f"max({value})" if numeric else "NULL::DOUBLE",
            "skew": f"skewness({value})" if numeric else "NULL::DOUBLE",
            "kurt": f"kurtosis({value})" if numeric else "NULL::DOUBLE",
            "pop_kurt": f"kurtosis_pop({value})" if numeric else "NULL::DOUBLE",
            "numbers": f"count(try_cast({c} AS DOUBLE))" if text else "NULL::BIGINT",
            "dates": f"greatest(count({parsed_date(c)}), count({parsed_date(c, '%d', '%m')}))" if text else "NULL::BIGINT",
            "at_signs": f"count(CASE WHEN contains({c}, '@') THEN 1 END)" if text else "NULL::BIGINT",
            "emails": f"count(CASE WHEN regexp_matches({c}, '{EMAIL}') THEN 1 END)" if text else "NULL::BIGINT",
            "padded": f"coalesce(bool_or({c} LIKE ' %' OR {c} LIKE '% '), false)" if text else "false",
            "constant": f"coalesce(min({c}) = max({c}), false)",
            "constant_value": f"CAST(min({c}) AS VARCHAR)",
        }
        listed = ", ".join(f"{sql} AS {label}" for label, sql in figures.items())
        rows.append(
            f"SELECT {i} AS position, '{names.get(c, c)}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, "
            f"count({c}) AS filled, count(*) - count({c}) AS nulls, {listed} FROM t"
        )
        if numeric:
            outliers.append(
                f"SELECT {i} AS position, count(*) AS outliers FROM t, base WHERE base.position = {i} AND base.filled >= 4 "
                f"AND base.q1 <> base.q3 AND ({value} < base.q1 - 1.5 * (base.q3 - base.q1) "
                f"OR {value} > base.q3 + 1.5 * (base.q3 - base.q1))"
            )
    return f"""WITH t AS ({plain(view)}),
    base AS ({' UNION ALL '.join(rows)}),
    beyond AS ({' UNION ALL '.join(outliers) or 'SELECT 0 AS position, 0 AS outliers'}),
    facts AS (SELECT base.*, coalesce(beyond.outliers, 0) AS outliers FROM base LEFT JOIN beyond USING (position)),
    dup AS (SELECT (SELECT count(*) FROM t) AS n_rows,
                   (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates)"""


def quality_checks() -> dict[str, str]:
    columns = (
        "{no} AS check_no, {position} AS position, '{kind}' AS type, {column} AS \"column\", {severity} AS severity, "
        "CAST({n} AS BIGINT) AS count, CAST({pct} AS DOUBLE) AS pct, {target} AS target, {details} AS details, {advice} AS recommendation"
    )

    def check(no, kind, severity, n, share, details, advice, source, where, column='"column"', position="position", target="NULL"):
        listed = columns.format(
            no=no, position=position, kind=kind, column=column, severity=severity, n=n, pct=share, target=target,
            details=details, advice=advice,
        )
        return f"SELECT {listed} FROM {source} WHERE {where}"

    missing = pct("nulls", "n_rows")
    repeats = pct("duplicates", "n_rows")
    distinct = pct("n_distinct", "n_rows")
    beyond = pct("outliers", "filled")
    invalid = pct("(filled - emails)", "filled")
    target = "CASE WHEN numbers >= 0.8 * filled THEN 'numeric' ELSE 'datetime' END"
    parsed = "CASE WHEN numbers >= 0.8 * filled THEN numbers ELSE dates END"
    parsed_pct = pct(f"({parsed})", "filled", 1)
    return {
        "missing_values": check(
            1, "missing_values",
            f"CASE WHEN {missing} >= 50 THEN 'critical' WHEN {missing} >= 20 THEN 'high' WHEN {missing} >= 5 THEN 'medium' ELSE 'low' END",
            "nulls", missing, f"nulls || ' missing values (' || {missing} || '%)'",
            f"CASE WHEN {missing} >= 50 THEN 'drop the column' WHEN kind = 'numeric' THEN 'fill with the median' ELSE 'fill with the mode' END",
            "facts", "nulls > 0",
        ),
        "duplicate_rows": check(
            2, "duplicate_rows",
            f"CASE WHEN {repeats} > 10 THEN 'high' WHEN {repeats} > 1 THEN 'medium' ELSE 'low' END",
            "duplicates", repeats, f"duplicates || ' duplicate rows (' || {repeats} || '%)'", "'drop the repeated rows'",
            "dup", "duplicates > 0", column="NULL", position="-1",
        ),
        "high_cardinality": check(
            3, "high_cardinality", "'medium'", "n_distinct", distinct,
            f"n_distinct || ' unique values (' || {distinct} || '% of rows)'", "'encode, bin or drop the column'",
            "facts", f"kind = 'text' AND (n_distinct > 100 OR {distinct} > 50)",
        ),
        "outliers": check(
            4, "outliers", f"CASE WHEN {beyond} > 10 THEN 'high' WHEN {beyond} > 5 THEN 'medium' ELSE 'low' END",
            "outliers", beyond,
            f"outliers || ' outliers (' || {beyond} || '%) outside IQR [' || round(q1 - 1.5 * (q3 - q1), 2) || ', ' || "
            "round(q3 + 1.5 * (q3 - q1), 2) || ']'",
            "'inspect or clip the values'", "facts", "outliers > 0",
        ),
        "type_mismatch": check(
            5, "type_mismatch", "'medium'", parsed, parsed_pct,
            f"'Column is text but ' || {parsed_pct} || '% values are ' || {target}", f"'cast the column to ' || {target}",
            "facts", "kind = 'text' AND filled > 0 AND (numbers >= 0.8 * filled OR dates >= 0.8 * filled)", target=target,
        ),
        "constant_column": check(
            6, "constant_column", "CASE WHEN nulls > 0 THEN 'medium' ELSE 'high' END", "1", "NULL",
            "'only 1 unique value: ''' || constant_value || ''''", "'drop the constant column'", "facts", "constant",
        ),
        "invalid_emails": check(
            7, "invalid_emails", f"CASE WHEN {invalid} > 25 THEN 'high' ELSE 'medium' END", "filled - emails", invalid,
            f"(filled - emails) || ' invalid email addresses (' || {invalid} || '% of non-null values)'",
            "'validate the addresses'", "facts",
            "kind = 'text' AND filled > 0 AND (regexp_matches(lower(\"column\"), 'email|e_mail|mail|correo') "
            f"OR at_signs >= 0.2 * filled) AND {invalid} > 5",
        ),
    }


def one_check(view: str, kind: str, where: str = "true") -> str:
    return f"{column_facts(view)}\nSELECT * FROM ({quality_checks()[kind]}) WHERE {where}"


def with_issues(view: str) -> str:
    return f"{column_facts(view)},\nissues AS ({' UNION ALL '.join(quality_checks().values())})"


def with_actions(view: str) -> str:
    robust = "(coalesce(f.outliers, 0) > 0 OR abs(round(f.skew, 4)) > 1)"
    return f"""{with_issues(view)},
    joined AS (SELECT i.*, f.kind, {robust} AS robust FROM issues i LEFT JOIN facts f ON f."column" = i."column"),
    actions AS (
      SELECT position, "column", type AS issue_type, severity,
        CASE type
          WHEN 'missing_values' THEN CASE WHEN pct >= 50 THEN 'drop_column' WHEN kind = 'numeric' AND robust THEN 'median_imputation'
                                          WHEN kind = 'numeric' THEN 'mean_imputation' ELSE 'mode_imputation' END
          WHEN 'duplicate_rows' THEN 'remove_duplicates'
          WHEN 'outliers' THEN CASE WHEN pct > 10 THEN 'clip_outliers' ELSE 'remove_outliers' END
          WHEN 'high_cardinality' THEN CASE WHEN pct > 80 THEN 'drop_column' WHEN pct > 30 THEN 'frequency_encoding' ELSE 'target_encoding' END
          WHEN 'type_mismatch' THEN 'cast_' || target
          WHEN 'constant_column' THEN 'drop_constant'
          WHEN 'invalid_emails' THEN 'validate_emails' END AS recommendation,
        CAST(CASE type
          WHEN 'missing_values' THEN CASE WHEN pct >= 50 OR (kind = 'numeric' AND robust) THEN 0.92 ELSE 0.75 END
          WHEN 'duplicate_rows' THEN CASE WHEN pct > 5 THEN 0.92 ELSE 0.75 END
          WHEN 'outliers' THEN CASE WHEN pct > 10 THEN 0.75 ELSE 0.92 END
          WHEN 'high_cardinality' THEN CASE WHEN pct > 80 THEN 0.92 WHEN pct > 30 THEN 0.75 ELSE 0.55 END
          WHEN 'type_mismatch' THEN CASE WHEN pct >= 95 THEN 0.92 ELSE 0.75 END
          WHEN 'constant_column' THEN 0.92
          WHEN 'invalid_emails' THEN CASE WHEN pct > 25 THEN 0.92 ELSE 0.75 END END AS DOUBLE) AS confidence,
        CASE type
          WHEN 'missing_values' THEN pct < 50
          WHEN 'high_cardinality' THEN pct > 30 AND pct <= 80
          WHEN 'constant_column' THEN false
          WHEN 'invalid_emails' THEN false
          ELSE true END AS auto_applicable
      FROM joined)"""


ACTION_COLUMNS = '"column", issue_type, severity, recommendation, confidence, auto_applicable'
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


def actions_of(view: str, kind: str) -> str:
    return f"{with_actions(view)}\nSELECT {ACTION_COLUMNS} FROM actions WHERE issue_type = '{kind}'"


def readiness(view: str) -> str:
    """Named subquery ``ready`` behind the facts of a view."""
    n = len(SHAPES[view])
    return f"""{column_facts(view)},
    lost AS (
      SELECT CAST(least(30, 10 * count(CASE WHEN nulls * 100.0 / n_rows >= 30 THEN 1 END)) AS INT) AS lost_missing,
        CAST(CASE WHEN (SELECT duplicates * 100.0 / n_rows FROM dup) > 5 THEN 10 ELSE 0 END AS INT) AS lost_duplicates,
        CAST(least(15, 5 * count(CASE WHEN kind = 'text' AND n_distinct > 50 THEN 1 END)) AS INT) AS lost_cardinality,
        CAST(least(15, 5 * count(CASE WHEN outliers * 100.0 / nullif(filled, 0) > 10 THEN 1 END)) AS INT) AS lost_outliers,
        CAST(CASE WHEN max(n_rows) < 50 THEN 25 WHEN max(n_rows) < 100 THEN 15 ELSE 0 END AS INT) AS lost_size,
        CAST({20 if n <= 1 else 0} AS INT) AS lost_columns
      FROM facts),
    scored AS (SELECT *, CAST(greatest(0, least(100, 100 - lost_missing - lost_duplicates - lost_cardinality - lost_outliers
                 - lost_size - lost_columns)) AS INT) AS score FROM lost),
    ready AS (SELECT *, {GRADE} AS grade FROM scored)"""


QUALITY_SCORE = f"""
    quality_points AS (
      SELECT CAST(greatest(0, least(100, 100 - coalesce(sum(CASE WHEN type = 'missing_values' AND pct >= 50 THEN 20
          WHEN severity = 'critical' THEN 20 WHEN severity = 'high' THEN 10 WHEN severity = 'medium' THEN 5 ELSE 2 END), 0)
        - (SELECT CASE WHEN n_rows < 50 THEN 25 WHEN n_rows < 100 THEN 15 ELSE 0 END FROM dup))) AS INT) AS score
      FROM issues),
    quality AS (SELECT score, {GRADE} AS grade FROM quality_points)"""

GAIN = """
    gains AS (SELECT CASE recommendation WHEN 'remove_duplicates' THEN 8 WHEN 'mean_imputation' THEN 4 WHEN 'median_imputation' THEN 4
        WHEN 'remove_outliers' THEN 4 WHEN 'drop_constant' THEN 4 WHEN 'cast_datetime' THEN 2 WHEN 'validate_emails' THEN 2 ELSE 3 END AS gain,
        auto_applicable FROM actions),
    won AS (SELECT coalesce(sum(CASE WHEN auto_applicable THEN gain ELSE gain // 2 END), 0) AS gain FROM gains),
    estimate AS (SELECT score, grade, CAST(least(100, score + won.gain) AS INT) AS estimated_score FROM quality, won)"""


def define(name: str, statement: str) -> None:
    ORACLE[name] = statement


# -- questions --------------------------------------------------------------

define("q1_count", "SELECT count(*) AS count FROM lineitem")
define("q2_mean", of("dirty_events", "SELECT round(avg(amount), 6) AS amount FROM t"))
define("q3_sum", "SELECT round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem")
define("q4_min", of("dirty_events", "SELECT min(amount) AS amount FROM t"))
define("q5_max", "SELECT max(o_totalprice) AS o_totalprice FROM orders")
define(
    "q6_group_mean",
    of("dirty_events", "SELECT event_type, round(avg(amount), 6) AS amount FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 1"),
)
define("q6_group_sum", "SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1 ORDER BY 1")
define("q6_group_min", "SELECT o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1 ORDER BY 1")
define(
    "q6_group_max",
    of("dirty_events", "SELECT event_type, max(rare_amount) AS rare_amount FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 1"),
)
define("q7_filter_greater", "SELECT * FROM orders WHERE o_totalprice > 250000")
define("q7_filter_not_equal", of("sparse_orders", "SELECT * FROM t WHERE priority IS DISTINCT FROM '2-HIGH'"))
define("q7_filter_equal", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
define("q7_filter_at_most", "SELECT * FROM lineitem WHERE l_quantity <= 10")
define("q8_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")


def describe_sql(view: str) -> str:
    return (
        f"{column_facts(view)}\nSELECT \"column\", filled AS count, round(mean, 7) AS mean, round(std, 7) AS std, round(low, 7) AS min, "
        "round(q1, 7) AS q25, round(median, 7) AS q50, round(q3, 7) AS q75, round(high, 7) AS max FROM facts WHERE kind = 'numeric'"
    )


define("q9_describe", describe_sql("dirty_events"))
define(
    "q10_result_cap",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 500",
)
define("q10_truncation", "SELECT count(*) > 500 AS truncated, count(*) AS total_rows, least(count(*), 500) AS returned_rows FROM events")
define("q11_page", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 75")
define(
    "q12_top_groups",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10",
)
define("q13_distinct_count", 'SELECT count(DISTINCT l_partkey) AS "distinct" FROM lineitem')
define("q14_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem")
define("q15_filter_then_sum", "SELECT round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
define(
    "q16_adhoc_sql",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, "
    "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2",
)

# -- profile ----------------------------------------------------------------

SPARK_TYPES = {"event_id": "bigint", "user_id": "bigint", "ts": "timestamp_ntz"}


def spark_type(column: str, kind: str) -> str:
    return SPARK_TYPES.get(column, "double" if kind == N else "string")


def shape_sql(view: str) -> str:
    kinds = list(SHAPES[view].values())
    types = " ".join(f"WHEN '{c}' THEN '{spark_type(c, k)}'" for c, k in SHAPES[view].items())
    return (
        f"{column_facts(view)}\nSELECT position, \"column\", CASE \"column\" {types} END AS data_type, kind, n_rows AS rows, "
        f"{len(kinds)} AS columns, {kinds.count(N)} AS numeric_columns, {kinds.count(T) + kinds.count(B)} AS categorical_columns FROM facts"
    )


define("p1_shape", shape_sql("dirty_events"))
define(
    "p2_missing",
    f"{column_facts('dirty_events')}\nSELECT position, \"column\", nulls AS null_count, {pct('nulls', 'n_rows')} AS null_percentage FROM facts",
)
define("p3_duplicate_rows", f"{column_facts('repeated_events')}\nSELECT duplicates, {pct('duplicates', 'n_rows')} AS percentage FROM dup")
define(
    "p3_duplicate_texts",
    "SELECT count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) * 100.0::DOUBLE / count(*), 2) AS percentage FROM documents",
)


def numeric_sql(view: str) -> str:
    def corrected(sample: str, least: int) -> str:
        return f"round(CASE WHEN filled < {least} THEN NULL ELSE coalesce({sample}, 0) END, 4)"

    return (
        f"{column_facts(view)}\nSELECT \"column\", round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, "
        f"round(low, 4) AS min, round(high, 4) AS max, {corrected('skew', 3)} AS skewness, {corrected('kurt', 4)} AS kurtosis, "
        "round(q1, 4) AS q1, round(q3, 4) AS q3 FROM facts WHERE kind = 'numeric' AND filled > 0"
    )


define("p4_numeric_statistics", numeric_sql("lineitem"))
define("p4_numeric_statistics_dirty", numeric_sql("dirty_events"))


def value_counts_sql(view: str, columns: list[str], k: int) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM t WHERE {c} IS NOT NULL" for c in columns)
    return f"""WITH t AS ({plain(view)}), cells AS ({cells}),
    counted AS (SELECT "column", value, count(*) AS count FROM cells GROUP BY "column", value),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INT) AS rank FROM counted)
    SELECT "column", value, count, rank FROM ranked WHERE rank <= {k}"""


define("p5_value_counts", value_counts_sql("dirty_events", [c for c, k in SHAPES["dirty_events"].items() if k == T], 10))
define("p5_value_counts_texts", value_counts_sql("documents", ["text", "lang", "source"], 5))
define("p6_numeric_summary", describe_sql("lineitem"))
define(
    "p7_completeness",
    f"{column_facts('repeated_lines')}\nSELECT max(n_rows) AS total_rows, {len(SHAPES['repeated_lines'])} AS total_columns, "
    f"(SELECT duplicates FROM dup) AS duplicate_rows, {pct('sum(filled)', 'sum(n_rows)')} AS completeness_score FROM facts",
)


def schema_sheet_sql(view: str) -> str:
    types = " ".join(f"WHEN '{c}' THEN '{spark_type(c, k)}'" for c, k in SHAPES[view].items())
    examples = " ".join(
        f"WHEN '{c}' THEN (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))"
        for c, k in SHAPES[view].items() if k == T
    )
    return (
        f"{column_facts(view)}\nSELECT position, \"column\", CASE \"column\" {types} END AS data_type, {pct('nulls', 'n_rows', 1)} AS missing_pct, "
        f"CASE WHEN n_distinct < 20 THEN CASE \"column\" {examples} END END AS examples FROM facts"
    )


define("p8_schema_sheet", schema_sheet_sql("dirty_events"))
define(
    "p9_mask_names",
    'SELECT c_custkey, c_name AS "[ANONYMIZED_PII_1]", c_nationkey, c_acctbal, c_mktsegment FROM customer',
)

# -- quality ----------------------------------------------------------------

define("k1_missing", one_check("dirty_events", "missing_values"))
define("k2_duplicates", one_check("repeated_events", "duplicate_rows"))
define("k3_high_cardinality", one_check("documents", "high_cardinality"))
define("k4_outliers", one_check("dirty_events", "outliers"))
define("k4_outliers_lineitem", one_check("lineitem", "outliers"))
define("k4_outliers_documents", one_check("documents", "outliers"))
define("k5_text_is_numeric", one_check("order_texts", "type_mismatch", "target = 'numeric'"))
define("k6_text_is_datetime", one_check("order_texts", "type_mismatch", "target = 'datetime'"))
define("k6_date_layouts", one_check("dated_orders", "type_mismatch"))
define("k7_constant", one_check("dirty_events", "constant_column"))
define("k8_invalid_emails", one_check("dirty_events", "invalid_emails"))
define("k9_report", f"{with_issues('dirty_events')}\nSELECT * FROM issues")
define("k9_report_repeats", f"{with_issues('repeated_lines')}\nSELECT * FROM issues")

MESSY = {"o_orderkey": "Order Key", "rare_price": "Rare-Price", "fixed": "FIXED"}
HYGIENE_SUGGESTION = {
    "missing_values": (
        "\"column\" || ': ' || percentage || '% of the cells are empty, ' || "
        "CASE WHEN percentage > 50 THEN 'leave it out' ELSE 'give them a value' END"
    ),
    "duplicate_rows": "'keep one of each repeated row: ' || count || ' go'",
    "whitespace": "\"column\" || ': trim blanks at the ends'",
    "wrong_dtype_numeric": "\"column\" || ': numbers held as text, make them numbers'",
    "wrong_dtype_datetime": "\"column\" || ': dates held as text, make them times'",
    "constant_column": "\"column\" || ': the same in every row, leave it out'",
    "all_null_column": "\"column\" || ': empty, leave it out'",
    "messy_column_names": "'names: lower case and underscores only'",
}


def hygiene_checks() -> dict[str, str]:
    def check(no, kind, severity, n, share, where, source="facts", named=True):
        column, position = ('"column"', "position") if named else ("NULL::VARCHAR", "-1")
        return (
            f"SELECT {no} AS check_no, {position} AS position, '{kind}' AS type, {column} AS \"column\", {severity} AS severity, "
            f"CAST({n} AS BIGINT) AS count, CAST({share} AS DOUBLE) AS percentage FROM {source} WHERE {where}"
        )

    share = pct("nulls", "n_rows", 1)
    return {
        "missing": check(
            1, "missing_values", f"CASE WHEN {share} > 30 THEN 'high' WHEN {share} > 10 THEN 'medium' ELSE 'low' END", "nulls", share, "nulls > 0"
        ),
        "duplicates": check(
            2, "duplicate_rows", "CASE WHEN duplicates > n_rows * 0.05 THEN 'high' ELSE 'medium' END", "duplicates",
            pct("duplicates", "n_rows", 1), "duplicates > 0", "dup", named=False,
        ),
        "whitespace": check(3, "whitespace", "'low'", "NULL", "NULL", "padded"),
        "numeric": check(4, "wrong_dtype_numeric", "'medium'", "NULL", "NULL", "kind = 'text' AND numbers > filled * 0.85"),
        "date": check(5, "wrong_dtype_datetime", "'low'", "NULL", "NULL", "kind = 'text' AND dates > filled * 0.8"),
        "constant": check(6, "constant_column", "'low'", "NULL", "NULL", "constant OR filled = 0"),
        "empty": check(7, "all_null_column", "'high'", "n_rows", "100.0", "filled = 0"),
        "names": check(
            8, "messy_column_names", "'low'", "n", "NULL", "n > 0",
            "(SELECT count(*) AS n FROM facts WHERE NOT regexp_full_match(\"column\", '[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*'))", named=False,
        ),
    }


def hygiene_check(view: str, kind: str, names: dict[str, str] | None = None) -> str:
    return f"{column_facts(view, names)}\n{hygiene_checks()[kind]}"


HYGIENE = (
    f"{column_facts('sparse_orders', MESSY)},\nfound AS ({' UNION ALL '.join(hygiene_checks().values())}),\n"
    f"report AS (SELECT *, CASE type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {s}' for k, s in HYGIENE_SUGGESTION.items())} END AS suggestion FROM found)"
)
define("k10_missing", hygiene_check("dirty_events", "missing"))
define("k11_duplicates", hygiene_check("repeated_events", "duplicates"))
define("k12_whitespace", hygiene_check("dirty_events", "whitespace"))
define("k13_looks_numeric", hygiene_check("order_texts", "numeric"))
define("k14_looks_like_date", hygiene_check("order_texts", "date"))
define("k14_date_layouts", hygiene_check("dated_orders", "date"))
define("k15_constant_or_empty", hygiene_check("sparse_orders", "constant"))
define("k16_all_null", hygiene_check("sparse_orders", "empty"))
define("k17_messy_names", hygiene_check("sparse_orders", "names", MESSY))
define("k18_report", f"{HYGIENE}\nSELECT * FROM report")
define(
    "k18_verdict",
    f"{HYGIENE}\nSELECT count(*) AS issue_count, CASE WHEN count(CASE WHEN severity = 'high' THEN 1 END) > 0 THEN 'major' "
    "WHEN count(*) > 0 THEN 'minor' ELSE 'clean' END AS verdict FROM report",
)


def seen(kind: str) -> str:
    return f"coalesce(bool_or(type = '{kind}'), false)"


define(
    "k19_options",
    f"""{HYGIENE}
    SELECT {seen('duplicate_rows')} AS drop_duplicates, {seen('missing_values')} AS fill_missing_numeric,
      {seen('missing_values')} AS fill_missing_categorical, {seen('whitespace')} AS strip_whitespace,
      {seen('wrong_dtype_numeric')} AS convert_numeric, {seen('wrong_dtype_datetime')} AS parse_dates,
      {seen('constant_column')} AS drop_constant_cols, {seen('all_null_column')} AS drop_all_null_cols,
      {seen('messy_column_names')} AS standardise_col_names,
      coalesce(bool_or(type = 'missing_values' AND percentage > 50), false) AS drop_high_missing
    FROM report""",
)

# -- scores -----------------------------------------------------------------

define("r1_readiness", f"{readiness('dirty_events')}\nSELECT * FROM ready")
define("r1_readiness_repeats", f"{readiness('repeated_events')}\nSELECT * FROM ready")
define(
    "r1_findings",
    f"""{column_facts('dirty_events')},
    flags AS (SELECT *, nulls * 100.0::DOUBLE / n_rows AS null_pct, outliers * 100.0::DOUBLE / filled AS outlier_pct FROM facts)
    SELECT 'missing' AS "check", 'problem' AS verdict, "column", round(null_pct, 1) AS value FROM flags WHERE null_pct >= 30
    UNION ALL SELECT 'missing', 'strength', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM flags WHERE null_pct >= 30)
    UNION ALL SELECT 'duplicates', CASE WHEN duplicates * 100.0 / n_rows > 5 THEN 'problem' ELSE 'strength' END, NULL, {pct('duplicates', 'n_rows', 1)} FROM dup
    UNION ALL SELECT 'cardinality', 'problem', "column", CAST(n_distinct AS DOUBLE) FROM flags WHERE kind = 'text' AND n_distinct > 50
    UNION ALL SELECT 'cardinality', 'strength', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM flags WHERE kind = 'text' AND n_distinct > 50)
    UNION ALL SELECT 'outliers', 'problem', "column", round(outlier_pct, 1) FROM flags WHERE outlier_pct > 10
    UNION ALL SELECT 'outliers', 'strength', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM flags WHERE outlier_pct > 10)
    UNION ALL SELECT 'size', CASE WHEN n_rows < 100 THEN 'problem' ELSE 'strength' END, NULL, CAST(n_rows AS DOUBLE) FROM dup
    UNION ALL SELECT 'columns', 'strength', NULL, {len(SHAPES['dirty_events'])}.0::DOUBLE""",
)
define("r2_grade", f"{readiness('sparse_orders')}\nSELECT score, grade FROM ready")
define("r3_quality_score", f"{with_issues('dirty_events')},{QUALITY_SCORE}\nSELECT * FROM quality")
define("r4_estimated_score", f"{with_actions('repeated_lines')},{QUALITY_SCORE},{GAIN}\nSELECT * FROM estimate")
define(
    "r5_plan_summary",
    f"""{with_actions('repeated_lines')},{QUALITY_SCORE},{GAIN},
    tally AS (SELECT count(*) AS total_issues, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical_issues,
      count(CASE WHEN severity = 'high' THEN 1 END) AS high_risk_issues, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium_risk_issues,
      count(CASE WHEN severity = 'low' THEN 1 END) AS low_risk_issues, count(CASE WHEN auto_applicable THEN 1 END) AS auto_applicable_count FROM actions)
    SELECT tally.*, estimate.* FROM tally, estimate""",
)
LINES = "repeated_lines"
DEDUPED = "d AS (SELECT DISTINCT * FROM t)"
FILLED = "filled AS (SELECT * REPLACE (coalesce(discount, (SELECT avg(discount) FROM d)) AS discount) FROM d)"
define(
    "r6_before_after",
    f"""{readiness(LINES)}, {DEDUPED}, after_rows AS (SELECT count(*) AS n FROM d)
    SELECT (SELECT n_rows FROM dup) AS rows_before, 5 AS columns_before, ready.score AS score_before, n AS rows_after, 5 AS columns_after,
      CASE WHEN n < 50 THEN 75 WHEN n < 100 THEN 85 ELSE 100 END AS score_after,
      CASE WHEN n < 50 THEN 75 WHEN n < 100 THEN 85 ELSE 100 END - ready.score AS improvement
    FROM ready, after_rows""",
)

# -- recommendations --------------------------------------------------------

define("l1_missing", actions_of("dirty_events", "missing_values"))
define("l2_duplicates", actions_of("repeated_events", "duplicate_rows"))
define("l3_outliers", actions_of("dirty_events", "outliers"))
define("l4_high_cardinality", actions_of("documents", "high_cardinality"))
define("l5_type_mismatch", actions_of("order_texts", "type_mismatch"))
define("l6_constant", actions_of("dirty_events", "constant_column"))
define("l7_invalid_emails", actions_of("dirty_events", "invalid_emails"))
define("l8_whole_plan", f"{with_actions('dirty_events')}\nSELECT position, {ACTION_COLUMNS} FROM actions")
define(
    "l9_simple_plan",
    f"""{with_issues('dirty_events')}
    SELECT type AS issue, i."column", CASE type
        WHEN 'missing_values' THEN CASE WHEN kind = 'numeric' AND outliers > 0 THEN 'median_imputation' WHEN kind = 'numeric' THEN 'mean_imputation' ELSE 'mode_imputation' END
        WHEN 'duplicate_rows' THEN 'remove_duplicates' WHEN 'outliers' THEN 'remove_outliers'
        WHEN 'high_cardinality' THEN CASE WHEN pct > 80 THEN 'drop_column' ELSE 'target_encoding' END
        ELSE 'cast_datatype' END AS action
    FROM issues i LEFT JOIN facts f ON f."column" = i."column" WHERE type NOT IN ('constant_column', 'invalid_emails')""",
)

# -- cleaning ---------------------------------------------------------------

DIRTY = "dirty_events"


def replaced(view: str, with_clause: str = "", source: str = "t", where: str = "true", **changed: str) -> str:
    return of(view, f"SELECT {rest(view, **changed)} FROM {source} {with_clause} WHERE {where}")


def rounded(view: str, *columns: str, **changed: str) -> str:
    return replaced(view, **{c: f"round({sql}, 6)" for c, sql in changed.items()})


FENCES = (
    ", (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)) AS fence"
)
define("c1_mean", rounded(DIRTY, amount="coalesce(amount, (SELECT avg(amount) FROM t))"))
define("c2_median", rounded(DIRTY, amount="coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM t))"))
define(
    "c3_mode",
    replaced(
        DIRTY,
        event_type="coalesce(event_type, (SELECT event_type FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
    ),
)
define("c4_constant", replaced(DIRTY, amount="coalesce(amount, 0)", event_type="coalesce(event_type, 'missing')"))
define("c5_duplicates", of("repeated_events", "SELECT DISTINCT * FROM t"))
define(
    "c6_clip",
    replaced(DIRTY, FENCES.format(c="amount"), amount="round(CASE WHEN amount < lo THEN lo WHEN amount > hi THEN hi ELSE amount END, 6)"),
)
define("c7_remove_outliers", replaced(DIRTY, FENCES.format(c="amount"), where="amount IS NULL OR amount BETWEEN lo AND hi"))
define("c8_log", rounded(DIRTY, amount="ln(1 + amount)"))
SHARE = "count(*) OVER (PARTITION BY {c}) / (SELECT count({c}) FROM t)::DOUBLE"
define("c9_frequency", rounded(DIRTY, event_type=f"CASE WHEN event_type IS NOT NULL THEN {SHARE.format(c='event_type')} END"))
define("c9_frequency_texts", rounded("documents", text=SHARE.format(c="text")))
define("c10_cast_numeric", replaced("order_texts", mostly_number="try_cast(mostly_number AS BIGINT)"))
define(
    "c11_cast_datetime", replaced("order_texts", mostly_date="try_cast(mostly_date AS TIMESTAMP)", us_date="strptime(us_date, '%m/%d/%Y')")
)
define(
    "c12_cast_legacy",
    replaced("order_texts", partly_number="try_cast(partly_number AS BIGINT)", us_date="strptime(us_date, '%m/%d/%Y')"),
)
DATES_READ = replaced(
    "dated_orders", day_first="strptime(day_first, '%d/%m/%Y')", month_first="strptime(month_first, '%m/%d/%Y')",
    dotted="strptime(dotted, '%d.%m.%Y')", with_time="strptime(with_time, '%d-%m-%Y %H:%M')",
    mostly_day_first="try_strptime(mostly_day_first, '%d/%m/%Y')", either_order="strptime(either_order, '%m/%d/%Y')",
)
define("c11_date_layouts", DATES_READ)
define("c12_date_layouts", DATES_READ)
define("c26_date_layouts", DATES_READ)
define(
    "c13_emails",
    of(
        "contacts",
        f"SELECT c_custkey, c_acctbal, CASE WHEN regexp_matches(lower({stripped('email')}), '{EMAIL}') THEN lower({stripped('email')}) END AS email, "
        "segment FROM t",
    ),
)
define("c14_trim", of("contacts", f"SELECT c_custkey, c_acctbal, email, {stripped('segment')} AS segment FROM t"))
define("c15_drop_constant", of("sparse_orders", "SELECT * EXCLUDE (fixed, empty_note) FROM t"))
define("c16_drop_column", of(DIRTY, "SELECT * EXCLUDE (rare_amount) FROM t"))
define("c19_target", rounded(DIRTY, event_type="CASE WHEN event_type IS NOT NULL THEN avg(spiky) OVER (PARTITION BY event_type) END"))

LINE_FENCES = (
    "fence AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
    "(SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM filled))"
)
CHAINED = f"WITH t AS ({plain(LINES)}), {DEDUPED}, {FILLED}, {LINE_FENCES}"
COUNTED = {
    "missing_values_filled": "(SELECT count(*) FROM d WHERE discount IS NULL)",
    "duplicates_removed": "(SELECT count(*) FROM t) - (SELECT count(*) FROM d)",
    "outliers_clipped": "(SELECT count(*) FROM filled, fence WHERE l_quantity < lo OR l_quantity > hi)",
    "outliers_removed": "0", "columns_log_transformed": "0", "columns_frequency_encoded": "1", "columns_target_encoded": "0",
    "emails_cleaned": "0", "text_trimmed": "0",
}
define(
    "c17_audit",
    f"{CHAINED}\n" + " UNION ALL ".join(f"SELECT '{name}' AS counter, CAST({sql} AS BIGINT) AS amount" for name, sql in COUNTED.items()),
)
define("c18_selective", rounded(LINES, discount="coalesce(discount, (SELECT avg(discount) FROM t))"))
define(
    "c18_chain",
    f"{CHAINED}\nSELECT round(count(*) OVER (PARTITION BY l_returnflag) / (SELECT count(*) FROM filled)::DOUBLE, 6) AS l_returnflag, l_linestatus, "
    "l_linenumber, greatest(lo, least(hi, l_quantity)) AS l_quantity, round(discount, 6) AS discount FROM filled, fence",
)

SPARSE = "sparse_orders"
define("c20_drop_all_null", of(SPARSE, "SELECT * EXCLUDE (empty_note) FROM t"))
define("c21_drop_high_missing", of(SPARSE, "SELECT * EXCLUDE (empty_note, rare_price) FROM t"))
define("c22_drop_constant", of(SPARSE, "SELECT * EXCLUDE (empty_note, fixed) FROM t"))
define("c23_drop_duplicates", of(LINES, "SELECT DISTINCT * FROM t"))
define("c24_strip", replaced(SPARSE, padded_status="trim(padded_status)"))
define("c25_convert_numeric", replaced(SPARSE, customer_text="CAST(customer_text AS BIGINT)"))
define("c26_parse_dates", replaced(SPARSE, date_text="CAST(date_text AS TIMESTAMP)"))
define(
    "c27_fill_numeric",
    rounded(
        SPARSE, price="coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t))",
        rare_price="coalesce(rare_price, (SELECT quantile_cont(rare_price, 0.5) FROM t))",
    ),
)
define("c28_fill_text", replaced(SPARSE, empty_note="coalesce(empty_note, 'Unknown')", priority="coalesce(priority, 'Unknown')"))
define("c29_column_names", of(SPARSE, "SELECT o_orderkey AS order_key, * EXCLUDE (o_orderkey) FROM t"))
define(
    "c29_all_options",
    of(
        SPARSE,
        "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)), 6) AS price, coalesce(priority, 'Unknown') AS priority, "
        "trim(padded_status) AS padded_status, CAST(customer_text AS BIGINT) AS customer_text, CAST(date_text AS TIMESTAMP) AS date_text FROM t",
    ),
)

# -- statistics and logs ----------------------------------------------------

STRENGTH = "CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END"
define(
    "t1_correlation",
    f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(CASE WHEN l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL THEN 1 END) AS n
      FROM lineitem) SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, {STRENGTH} AS strength FROM c""",
)


def trend_sql(table: str, date: str, value: str) -> str:
    return f"""WITH c AS (SELECT {date} AS d, {value} AS v FROM {table} WHERE {date} IS NOT NULL AND {value} IS NOT NULL),
    placed AS (SELECT d, v, rank() OVER (ORDER BY d) - 1 + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS i FROM c),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(v) AS sv, sum(v * i) AS siv FROM placed),
    ends AS (SELECT (SELECT avg(v) FROM c WHERE d = (SELECT min(d) FROM c)) AS a, (SELECT avg(v) FROM c WHERE d = (SELECT max(d) FROM c)) AS b),
    line AS (SELECT (siv - sv * (n - 1) / 2) / (n * (n * n - 1) / 12) AS slope FROM s)
    SELECT CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, round(slope, 6) AS slope, round(a, 6) AS start_value,
      round(b, 6) AS end_value, round((b - a) / a * 100, 6) AS change_percent FROM line, ends"""


define("t2_trend", trend_sql("events", "ts", "value"))
define("t2_trend_ties", trend_sql("orders", "o_orderdate", "o_totalprice"))


def distribution_sql(view: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(SHAPES[view].items()):
        if kind != N:
            continue
        v = f"CAST({c} AS DOUBLE)"
        centred = f"(SELECT avg(power({v} - m, {{p}})) FROM t, (SELECT avg({v}) AS m FROM t) WHERE {c} IS NOT NULL)"
        m2, m3, m4 = (centred.format(p=p) for p in (2, 3, 4))
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median, "
            f"round(stddev_samp({v}), 6) AS std, round({m3} / power({m2}, 1.5), 6) AS skewness, round({m4} / power({m2}, 2) - 3, 6) AS kurtosis, "
            f"min({v}) AS min, max({v}) AS max, round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.75), 6) AS q75 FROM t"
        )
    return of(view, " UNION ALL ".join(parts))


define("t3_distribution", distribution_sql(DIRTY))


def matrix_sql(view: str, columns: list[str], digits: int, label: str) -> str:
    cells = [
        f"SELECT '{a}' AS var1, '{b}' AS var2, round({f'corr({a}, {b})' if a != b else f'any_value(1.0::DOUBLE) FILTER ({a} IS NOT NULL)'}, {digits}) AS {label} FROM t"
        for a in columns for b in columns
    ]
    return of(view, " UNION ALL ".join(cells))


LINE_NUMBERS = [c for c, k in SHAPES["lineitem"].items() if k == N]
define("t4_correlation_matrix", matrix_sql("lineitem", LINE_NUMBERS, 6, "r"))
define(
    "t5_outlier_rows",
    "WITH t AS (SELECT * FROM events) SELECT t.* FROM t" + FENCES.format(c="value") + " WHERE value < lo OR value > hi",
)
FIRST_NUMBERS = [c for c, k in SHAPES[DIRTY].items() if k == N]
define(
    "t6_patterns",
    of(
        DIRTY,
        " UNION ALL ".join(
            [
                f"SELECT 'distribution' AS type, '{c}' AS first, NULL AS second, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
                f"NULL::DOUBLE AS r, '{c}: average ' || round(avg({c}), 2) || ', spread ' || round(stddev_samp({c}), 2) AS summary FROM t"
                for c in FIRST_NUMBERS[:5]
            ]
            + [
                f"SELECT 'correlation', '{a}', '{b}', NULL, NULL, round(r, 6), '{a} and {b} ' || CASE WHEN r > 0 THEN 'rise together' ELSE 'run against each other' END || ', r = ' || round(r, 3) FROM (SELECT corr({a}, {b}) AS r FROM t) WHERE abs(r) > 0.5"
                for i, a in enumerate(FIRST_NUMBERS[:3]) for b in FIRST_NUMBERS[i + 1 : 4]
            ]
        ),
    ),
)


def has(*words: str) -> str:
    return " OR ".join(f"lower(text) LIKE '%{w}%'" for w in words)


define(
    "t7_intents",
    of(
        "questions",
        f"""SELECT conv_id, turn, CASE
          WHEN {has('chart', 'plot', 'graph', 'visualize', 'trend', 'show me', 'draw')} THEN 'analysis_and_visualization'
          WHEN {has('insight', 'pattern', 'discover', 'anomaly', 'unusual', 'why')} THEN 'insights'
          WHEN {has('profile', 'profiling', 'schema', 'describe', 'overview', 'summary', 'shape')} THEN 'profiling'
          WHEN {has('quality', 'missing', 'duplicate', 'outlier', 'readiness', 'imbalance')} THEN 'quality_check'
          WHEN {has('clean', 'preprocess', 'fix data', 'repair')} THEN 'cleaning_report'
          ELSE 'analysis_only' END AS intent FROM t""",
    ),
)


def guardrails_sql(view: str, key: str) -> str:
    def any_of(patterns: tuple[str, ...]) -> str:
        return " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in patterns)

    return f"""WITH t AS ({plain(view)}), asked AS (SELECT *, {stripped('text')} AS q FROM t),
    judged AS (SELECT *, CASE WHEN length(q) < 3 THEN 'too_short' WHEN length(q) > 2000 THEN 'too_long'
      WHEN {any_of(INJECTION_PATTERNS)} THEN 'injection' WHEN {any_of(CODE_PATTERNS)} THEN 'code' ELSE 'ok' END AS reason FROM asked)
    SELECT {key}, reason, reason = 'ok' AS allowed FROM judged"""


define("t8_guardrails", guardrails_sql("questions", "conv_id, turn"))
define("t8_guardrails_documents", guardrails_sql("documents", "doc_id"))
TRACES = """WITH traces AS (
      SELECT user_id AS "user", CAST(CAST(ts AS DATE) AS VARCHAR) AS trace, min(ts) AS started_at, count(*) AS event_count,
        count(CASE WHEN event_type = 'error' THEN 1 END) = 0 AS success,
        CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms
      FROM events GROUP BY 1, 2),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY started_at DESC, trace) AS INT) AS rank FROM traces),
    kept AS (SELECT * FROM ranked WHERE rank <= 10)"""
define("t9_traces", f'{TRACES} SELECT "user", trace, event_count, success, rank, duration_ms FROM kept')
define(
    "t10_trace_totals",
    f"{TRACES} SELECT round(avg(duration_ms), 6) AS avg_duration_ms, count(CASE WHEN success THEN 1 END) AS succeeded, "
    "count(CASE WHEN NOT success THEN 1 END) AS failed FROM kept",
)
PAIRS = """WITH said AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS speaker
      FROM conversations WHERE role IN ('user', 'assistant', 'agent')),
    seen AS (SELECT *, lag(speaker) OVER w AS was, lag(text) OVER w AS asked, lead(speaker) OVER w AS next FROM said
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN speaker = 'user' THEN text WHEN was = 'user' THEN asked END AS question,
      CASE WHEN speaker = 'user' THEN '' ELSE text END AS answer FROM seen WHERE speaker = 'assistant' OR next IS NULL"""
define("t11_pairs", PAIRS)
define("t11_pairs_small_blocks", PAIRS)

# -- charts and insights ----------------------------------------------------


def roles_sql(view: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(SHAPES[view].items()):
        if kind == N:
            role = f"CASE WHEN count(DISTINCT {c}) <= 5 AND count(*) > 8 THEN 'categorical' ELSE 'numeric' END"
        else:
            role = "'datetime'" if kind == D or "date" in c or "time" in c else "'categorical'"
        parts.append(f"SELECT {i} AS position, '{c}' AS \"column\", {role} AS role, count(DISTINCT {c}) AS \"distinct\" FROM t")
    return of(view, " UNION ALL ".join(parts))


define("v1_roles", roles_sql("lineitem"))


def histogram_sql(table: str, column: str, label: str = "") -> str:
    return f"""SELECT {label} bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS count FROM (
      SELECT CAST(least(floor((CAST({column} AS DOUBLE) - lo) / w), 9) AS INT) AS bin, lo, w FROM {table},
        (SELECT CAST(min({column}) AS DOUBLE) AS lo, (CAST(max({column}) AS DOUBLE) - CAST(min({column}) AS DOUBLE)) / 10 AS w FROM {table}))
      GROUP BY bin, lo, w"""


define("v2_histogram", histogram_sql("events", "value"))
define(
    "v2_histograms",
    " UNION ALL ".join(histogram_sql("lineitem", c, f"'{c}' AS \"column\",") for c in ("l_orderkey", "l_partkey")),
)


def box_sql(view: str, columns: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in columns)
    return (
        f"{column_facts(view)}\nSELECT \"column\", low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, high, "
        "round(q1 - 1.5 * (q3 - q1), 6) AS fence_low, round(q3 + 1.5 * (q3 - q1), 6) AS fence_high, outliers "
        f"FROM facts WHERE \"column\" IN ({listed}) AND outliers > 0"
    )


define("v3_box_plots", box_sql("events", ["event_id", "user_id"]))
define("v3_box_plots_documents", box_sql("documents", ["doc_id", "n_chars"]))
define(
    "v4_pie",
    "SELECT event_type AS category, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 2) AS share "
    "FROM events GROUP BY 1 HAVING (SELECT count(DISTINCT event_type) FROM events) <= 5",
)


def bar_sql(table: str, column: str) -> str:
    return (
        f"SELECT {column} AS category, count(*) AS count FROM {table} GROUP BY 1 "
        f"HAVING (SELECT count(DISTINCT {column}) FROM {table}) BETWEEN 6 AND 20"
    )


define("v5_bar", bar_sql("part", "p_type"))
define("v5_bar_brands", bar_sql("documents", "source"))
define(
    "v6_time_line",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, round(avg(value), 6) AS value, count(value) AS points FROM events GROUP BY 1",
)
HEAT_COLUMNS = [c for c in LINE_NUMBERS]
define("v8_heat_map", matrix_sql("lineitem", HEAT_COLUMNS, 2, "correlation"))
define(
    "v9_missing_rates",
    f"{column_facts(DIRTY)}\nSELECT \"column\", {pct('nulls', 'n_rows')} AS null_percentage FROM facts WHERE nulls > 0",
)
define("v10_measure_by_category", "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")


def insights_sql(view: str) -> str:
    n = len(SHAPES[view])
    rank = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
    issues = " UNION ALL ".join(quality_checks().values())
    return f"""{readiness(view)},
    issues AS ({issues}),
    top AS (SELECT * FROM issues ORDER BY {rank}, check_no, position LIMIT 5),
    insights AS (
      SELECT 'statistical' AS category, 'Size of the table' AS title, n_rows || ' rows, {n} columns' AS description, 'LOW' AS severity,
        1.0::DOUBLE AS confidence_score FROM dup
      UNION ALL SELECT 'statistical', 'Rows that occur more than once', duplicates || ' duplicate rows (' || {pct('duplicates', 'n_rows')} || '%)', 'MEDIUM', 1.0
        FROM dup WHERE duplicates > 0
      UNION ALL SELECT 'quality', 'Quality finding in ' || coalesce("column", 'the table'), type || ': ' || details,
        CASE WHEN type IN ('missing_values', 'outliers') THEN 'MEDIUM' ELSE 'LOW' END, 0.95 FROM top
      UNION ALL SELECT 'ml_readiness', 'Readiness score ' || score || '/100', 'Grade ' || grade, CASE WHEN score > 75 THEN 'LOW' ELSE 'MEDIUM' END, 0.9
        FROM ready)"""


define("i1_insights", f"{insights_sql(LINES)}\nSELECT * FROM insights")
define("i2_filter", f"{insights_sql(DIRTY)}\nSELECT * FROM insights WHERE category = 'quality' AND severity = 'MEDIUM'")
define("i3_confidence", f"{insights_sql(DIRTY)}\nSELECT round(coalesce(avg(confidence_score), 0.85), 6) AS confidence FROM insights")
define("i4_issue_counts", f"{with_issues(DIRTY)}\nSELECT type, count(*) AS issues FROM issues GROUP BY 1")

# -- sources, sinks, versions -----------------------------------------------

define("s1_csv_source", "SELECT * FROM part")
define("s1_csv_line_breaks", "SELECT * FROM documents")
JSON_FLAT = (
    "SELECT event_id, user_id, ts, event_type AS info_kind, round(value, 6) AS info_detail_value, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS info_detail_props_k, props AS info_detail_text FROM events"
)
define("s2_json_flat", JSON_FLAT)
define("s2_json_array", JSON_FLAT)
define(
    "s2b_json_nested",
    "SELECT event_id, user_id, ts, event_type AS kind, round(value, 6) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events",
)
define("s3_parquet_source", "SELECT * FROM orders")
define("s4_parquet_sink", of(DIRTY, "SELECT * FROM t"))
define("s5_csv_sink", "SELECT * FROM events")
define("s6_validated", "SELECT * FROM nation")
define(
    "s7_catalogue",
    of(
        DIRTY,
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS name, '{spark_type(c, k)}' AS dtype, count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) AS unique_count FROM t"
            for i, (c, k) in enumerate(SHAPES[DIRTY].items())
        ),
    ),
)
define(
    "s8_ingest_record",
    f"{readiness('orders')}\nSELECT 'orders.csv' AS dataset_name, 'upload' AS source, (SELECT n_rows FROM dup) AS row_count, 6 AS column_count, "
    "score AS ml_readiness_score, 1 AS dataset_version, 'active' AS status, NULL::VARCHAR AS parent_dataset_id FROM ready",
)
define(
    "s9_source",
    of(
        "imports",
        "SELECT page_id, CASE WHEN url LIKE '%github.com%' OR url LIKE '%raw.githubusercontent.com%' THEN 'github' "
        "WHEN url LIKE '%kaggle.com%' THEN 'kaggle' ELSE 'cloud' END AS source FROM t",
    ),
)
define(
    "s10_versioned_write",
    f"""WITH t AS ({plain(DIRTY)}),
    fence AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
      (SELECT quantile_cont(spiky, 0.25) AS q1, quantile_cont(spiky, 0.75) AS q3 FROM t))
    SELECT * EXCLUDE (release, lo, hi) REPLACE (round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM t)), 6) AS amount,
      round(spiky, 6) AS spiky) FROM t, fence WHERE spiky IS NULL OR spiky BETWEEN lo AND hi""",
)
define("s11_restore", of(DIRTY, "SELECT * FROM t"))
define(
    "s12_latest_records",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1",
)
NUMBERED = f"WITH t AS ({plain('versions')}), n AS (SELECT *, row_number() OVER (ORDER BY dataset_id) AS place FROM t), owner AS (SELECT min(user_id) AS least FROM t)"
TEXT_IDS = "CAST(dataset_id AS VARCHAR) AS dataset_id, CAST(user_id AS VARCHAR) AS user_id"
define(
    "s12_by_owner",
    f"{NUMBERED} SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, dataset_version, upload_timestamp FROM n, owner WHERE user_id = least",
)
define(
    "s12_updated",
    f"{NUMBERED} SELECT {TEXT_IDS}, CAST(CASE WHEN place = 1 THEN 99 ELSE dataset_version END AS INT) AS dataset_version, "
    "CASE WHEN place <= 2 THEN 'archived' END AS status, CAST(CASE place WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM n",
)
define(
    "s12_deleted",
    f"{NUMBERED} SELECT {TEXT_IDS}, dataset_version, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS revision FROM n, owner WHERE place > 3 AND user_id <> least",
)
define(
    "s13_lineage_forest",
    f"""WITH RECURSIVE t AS ({plain('version_forest')}),
    walk(dataset_id, root, generation) AS (
      SELECT dataset_id, dataset_id, CAST(0 AS BIGINT) FROM t WHERE parent_dataset_id IS NULL OR parent_dataset_id NOT IN (SELECT dataset_id FROM t)
      UNION ALL SELECT t.dataset_id, walk.root, walk.generation + 1 FROM t JOIN walk ON t.parent_dataset_id = walk.dataset_id)
    SELECT * FROM walk""",
)
PLANS = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events)"
define("s14_latest", f"{PLANS} SELECT user_id, event_type, event_id, ts FROM p WHERE nth = 1")
define("s14_counts", "SELECT user_id, event_type, CAST(least(count(*), 10) AS BIGINT) AS plans FROM events GROUP BY ALL")
define(
    "s14_by_id",
    f"{PLANS} SELECT user_id, event_type, event_id, CAST(nth AS INT) AS nth FROM p "
    "WHERE event_id = (SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1)",
)
define("s14_purged", f"{PLANS} SELECT user_id, event_type, event_id, ts, round(value, 6) AS value FROM p WHERE nth <= 10 AND event_type <> 'error'")
LINEAGE = f"""WITH RECURSIVE t AS ({plain('versions')}),
    chain(id, parent, steps) AS (
      SELECT dataset_id, parent_dataset_id, 0 FROM t WHERE dataset_id = (SELECT max(dataset_id) FROM t)
      UNION ALL SELECT t.dataset_id, t.parent_dataset_id, steps + 1 FROM t JOIN chain ON t.dataset_id = chain.parent)"""
define(
    "s13_lineage",
    f"{LINEAGE} SELECT t.dataset_id, t.parent_dataset_id, t.dataset_version, (SELECT max(steps) FROM chain) - steps + 1 AS nth "
    "FROM t JOIN chain ON t.dataset_id = chain.id",
)
define(
    "s13_lineage_roots",
    f"""WITH RECURSIVE t AS ({plain('versions')}),
    walk(dataset_id, root, generation) AS (
      SELECT dataset_id, dataset_id, CAST(0 AS BIGINT) FROM t WHERE parent_dataset_id IS NULL
      UNION ALL SELECT t.dataset_id, walk.root, walk.generation + 1 FROM t JOIN walk ON t.parent_dataset_id = walk.dataset_id)
    SELECT * FROM walk""",
)
define(
    "s14_plan_history",
    "SELECT user_id, event_type, event_id, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS INT) AS nth "
    "FROM events) WHERE nth <= 10",
)
define("s15_listing", of("versions", "SELECT dataset_id, dataset_version FROM t ORDER BY upload_timestamp DESC, dataset_id"))

# -- samples: ordered by a digest that both engines compute ------------------

define(
    "v7_scatter",
    "SELECT round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem "
    "ORDER BY md5('42/' || l_orderkey || '/' || l_linenumber) LIMIT 1000",
)
define("v11_sample", "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events ORDER BY md5('42/' || event_id) LIMIT 1000")
