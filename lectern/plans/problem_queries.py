"""Queries of the general data-cleaning operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import intervals, record_triage
from lectern.plans.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered periods and gaps of each question set."""
    return intervals.periods_and_gaps(table(spark, d, "questions"), "set_id", "position.start_pos", "position.end_pos")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered positions and number of periods of each question set."""
    state = intervals.interval_states(table(spark, d, "questions"), "set_id", "position.start_pos", "position.end_pos")
    return state.selectExpr("set_id", "cast(size(starts) as bigint) as periods", "aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (x, y) -> x + y) as covered")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken records with their reason."""
    return record_triage.rejected_records(table(spark, d, "raw_lines")).select("line_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Good records as typed question rows."""
    return record_triage.loaded_records(table(spark, d, "raw_lines")).selectExpr("line_id", "question", "question_type", "size(choice) as choices", "array_join(answer, ',') as answer_csv", "position.start_pos as start_pos", "position.end_pos as end_pos")


_P3_PERIODS = """
WITH r AS (SELECT DISTINCT set_id, position.start_pos AS s, position.end_pos AS e FROM questions
           WHERE position.start_pos >= 0 AND position.end_pos > position.start_pos),
m AS (SELECT *, max(e) OVER (PARTITION BY set_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT set_id, min(s) AS s, max(e) AS e FROM g GROUP BY set_id, grp)
"""

ORACLE = {
    "p3_found": _P3_PERIODS
    + """SELECT set_id, 'period' AS kind, s AS start_pos, e AS end_pos FROM p
UNION ALL SELECT set_id, 'gap' AS kind, e AS start_pos, n AS end_pos
FROM (SELECT set_id, e, lead(s) OVER (PARTITION BY set_id ORDER BY s) AS n FROM p) WHERE n IS NOT NULL""",
    "p3_coverage": _P3_PERIODS + "SELECT set_id, count(*) AS periods, CAST(sum(e - s) AS BIGINT) AS covered FROM p GROUP BY set_id",
}

# JSON is checked for what DuckDB's reader lets pass: commas before a closing bracket, and numbers that JSON does not have.
_P5 = r"""
WITH l AS (SELECT DISTINCT line_id, regexp_replace(raw_line, '\r$', '') AS body FROM raw_lines WHERE line_no IS DISTINCT FROM 1 AND NOT regexp_full_match(raw_line, '\s*')),
m AS (SELECT *, string_split(regexp_replace(body, '"[^"]*"', chr(1), 'g'), ',') AS f FROM l),
o AS (SELECT *, len(list_filter(f, lambda x: contains(x, '"') OR (contains(x, chr(1)) AND NOT regexp_full_match(x, chr(1) || '+')))) = 0 AS quoting_ok FROM m),
c AS (SELECT *, regexp_extract_all(CASE WHEN quoting_ok AND len(f) = 6 THEN ',' || body END, ',("(?:[^"]|"")*"|[^",]*)', 1) AS v FROM o),
d AS (SELECT *, list_transform(v, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS w FROM c),
e AS (SELECT *, CASE WHEN json_valid(w[3]) AND NOT regexp_matches(w[3], ',\s*[}\]]') THEN w[3]::JSON END AS ch, CASE WHEN json_valid(w[4]) AND NOT regexp_matches(w[4], ',\s*[}\]]') THEN w[4]::JSON END AS an FROM d),
g AS (SELECT *, coalesce(json_type(ch) = 'OBJECT' AND len(list_distinct(json_keys(ch))) >= 2 AND len(list_filter(json_extract(ch, '$.*'), lambda x: json_type(x) <> 'VARCHAR')) = 0, false) AS ch_ok,
  coalesce(json_type(an) = 'ARRAY' AND json_array_length(an) >= 1 AND len(list_filter(json_extract(an, '$[*]'), lambda x: json_type(x) <> 'VARCHAR' OR NOT list_contains(json_keys(ch), json_extract_string(x, '$')))) = 0, false) AS an_ok FROM e)
SELECT {columns} FROM (SELECT *, CASE WHEN NOT quoting_ok THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count' WHEN regexp_full_match(w[1], '\s*') THEN 'question' WHEN NOT ch_ok THEN 'choice' WHEN NOT an_ok THEN 'answer'
  WHEN NOT regexp_full_match(w[5], '[0-9]+') OR NOT regexp_full_match(w[6], '[0-9]+') OR TRY_CAST(w[6] AS BIGINT) < TRY_CAST(w[5] AS BIGINT) THEN 'position' END AS reason FROM g) WHERE reason IS {good}
"""
ORACLE["p5_found"] = _P5.replace("{columns}", "line_id, reason").replace("{good}", "NOT NULL")
ORACLE["p5_loaded"] = _P5.replace("{columns}", "line_id, w[1] AS question, w[2] AS question_type, CAST(len(list_distinct(json_keys(ch))) AS INTEGER) AS choices, array_to_string(json_extract_string(an, '$[*]'), ',') AS answer_csv, CAST(w[5] AS BIGINT) AS start_pos, CAST(w[6] AS BIGINT) AS end_pos").replace("{good}", "NULL")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_coverage, p5_found, p5_loaded)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
