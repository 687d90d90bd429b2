"""Loading comma-separated question records that may be broken.

Every record is read permissively with an explicit, typed schema; one that the reader can't fit to it is marked corrupt and keeps
its raw text. Corrupt records are then classified by quoting, number of fields and casts; what the reader lets pass (stray
quotes, blank or untyped text inside fields, signs before a number) is checked by its content. Records that fail come out with
the first reason that applies, the others typed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import need_columns

FIELDS = ("question", "question_type", "choice", "answer", "start_pos", "end_pos")
REASONS = ("quoting", "column_count", "question", "choice", "answer", "position")
_RECORD = "question string, question_type string, choice string, answer string, start_pos bigint, end_pos bigint, _corrupt string"
_MARK = "\u0001"  # stands for one quoted stretch while fields are counted
_JSON_SCHEMA = T.StructType([T.StructField("choice_ok", T.BooleanType()), T.StructField("answer_ok", T.BooleanType()), T.StructField("choice", T.MapType(T.StringType(), T.StringType())), T.StructField("answer", T.ArrayType(T.StringType()))])


def _strict(text: str | None):
    def no(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=no) if text is not None else None
    except (ValueError, RecursionError):
        return None


def _whole(text: str) -> bool:
    """No lone surrogate, which no encoding can hold."""
    try:
        text.encode()
        return True
    except UnicodeEncodeError:
        return False


@F.pandas_udf(_JSON_SCHEMA)
def _json_fields(choice: pd.Series, answer: pd.Series) -> pd.DataFrame:
    out = []
    for c, a in zip(choice, answer):
        c, a = _strict(c), _strict(a)
        c_ok = isinstance(c, dict) and len(c) >= 2 and all(isinstance(v, str) and _whole(v) for v in c.values()) and all(map(_whole, c))
        a_ok = c_ok and isinstance(a, list) and len(a) >= 1 and all(isinstance(x, str) and x in c for x in a)
        out.append((c_ok, a_ok, c if c_ok else None, a if a_ok else None))
    return pd.DataFrame(out, columns=["choice_ok", "answer_ok", "choice", "answer"])


def classify_records(lines: DataFrame) -> DataFrame:
    """(line_id, reason, raw_line, the six fields typed): one row per delivered record; ``reason`` is null for good ones.

    ``lines`` has line_id, line_no and raw_line; other columns are ignored. The first line of a file (line_no 1) is its
    header; headers and records that are null or blank are skipped. A record delivered twice counts once. One carriage
    return at the record's end belongs to the line end. Reasons, the first that applies: a field is neither free of double
    quotes nor wholly enclosed in them with inner ones doubled ('quoting'); not six fields ('column_count'); blank question;
    choice is not a strict JSON object with at least two keys and only string values; answer is not a strict JSON array of
    at least one key of choice; start and end are not plain digits, end is before start, or one exceeds BIGINT ('position').
    """
    need_columns(lines, "line_id", "line_no", "raw_line")
    rows = (
        lines.select("line_id", "line_no", "raw_line")
        .where("raw_line is not null and not (line_no <=> 1)")
        .where(~F.col("raw_line").rlike(r"(?U)^\s*$"))
        .dropDuplicates(["line_id", "raw_line"])
    )
    body = F.regexp_replace("raw_line", r"\r\z", "")
    masked = F.split(F.regexp_replace(F.translate("body", _MARK, " "), r'"[^"]*"', _MARK), ",", -1)
    field_ok = lambda f: ~F.contains(f, F.lit('"')) & (~F.contains(f, F.lit(_MARK)) | f.rlike(f"^{_MARK}+\\z"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "lineSep": "\u0002", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\u0003", "emptyValue": ""}
    parsed = (
        rows.withColumn("body", body)
        .withColumn("masked", masked)
        .withColumn("quoting_ok", F.forall("masked", field_ok))
        .withColumn("n_fields", F.size("masked"))
        .drop("masked")
        .withColumn("r", F.from_csv("body", F.lit(_RECORD), options))
    )
    # not to be called once more by filters that are moved below it
    fields = parsed.withColumn("j", _json_fields.asNondeterministic()("r.choice", "r.answer"))
    blank = F.coalesce(F.col("r.question").rlike(r"(?U)^\s*\z"), F.lit(True))
    corrupt = F.col("r._corrupt").isNotNull() | F.col("r.start_pos").isNull() | F.col("r.end_pos").isNull()
    digits = F.col("body").rlike(r'(?:,[0-9]+|,"[0-9]+"){2}\z')  # the reader casts signs and other alphabets' digits, too
    reason = (
        F.when(~F.col("quoting_ok"), "quoting")
        .when(F.col("n_fields") != len(FIELDS), "column_count")
        .when(blank, "question")
        .when(~F.col("j.choice_ok"), "choice")
        .when(~F.col("j.answer_ok"), "answer")
        .when(corrupt | ~digits | (F.col("r.end_pos") < F.col("r.start_pos")), "position")
    )
    return fields.select("line_id", reason.alias("reason"), "raw_line", "r.question", "r.question_type", "j.choice", "j.answer", "r.start_pos", "r.end_pos")


def rejected_records(lines: DataFrame) -> DataFrame:
    """(line_id, reason, raw_line) of the records that fail; see :func:`classify_records`."""
    return classify_records(lines).where("reason is not null").select("line_id", "reason", "raw_line")


def loaded_records(lines: DataFrame) -> DataFrame:
    """The good records as typed question rows; see :func:`classify_records`."""
    return classify_records(lines).where("reason is null").drop("reason", "raw_line").withColumn("position", F.struct("start_pos", "end_pos")).drop("start_pos", "end_pos")
