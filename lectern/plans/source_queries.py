"""Queries that write the test tables as files of the tool and read them back, each beside the SQL of what must come out.

Files go to the folder that all executors share, under a name of their own, and stay there until it is emptied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.session import shared_dir, table
from lectern.schema import QUESTION, VALIDATED_QUESTION
from lectern.sources import files

_SQL: dict[str, str] = {}
_QUERIES: dict = {}
_ONCE = "SELECT DISTINCT ON ({k}) * FROM {t} ORDER BY {k}"


def _q(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/lectern-{name}-{uuid.uuid4().hex[:12]}.jsonl"


def _once(s, d, name: str, key: str) -> DataFrame:
    return table(s, d, name).dropDuplicates([key])


def _question_rows(s, d) -> DataFrame:
    return _once(s, d, "questions", "q_id").select(F.col("q_id").alias("n"), "q_id", *(f.name for f in QUESTION.fields))


_WITH_ID = T.StructType([T.StructField("q_id", T.LongType()), *QUESTION.fields])
_LIST = "array_to_string({c}, '|')"
_KEYS = "array_to_string(list_sort(map_keys(choice)), '|')"


def _flat(q: DataFrame) -> DataFrame:
    return q.select("q_id", "question", "question_type", F.array_join(F.array_sort(F.map_keys("choice")), "|").alias("keys"), F.array_join("answer", "|").alias("answer"), "position.start_pos", "position.end_pos")


_QUE = f"SELECT q_id, question, question_type, {_KEYS} AS keys, {_LIST.format(c='answer')} AS answer, position.start_pos AS start_pos, position.end_pos AS end_pos FROM ({_ONCE.format(k='q_id', t='questions')})"


@_q(_QUE)
def read_back_questions(s, d):
    """A question set written with its header, and read strictly."""
    at = _place(s, "questions")
    files.write_question_set(_question_rows(s, d), at, "2024-01-01T00:00:00", "n", config={"api_key": "x", "model": "m"})
    return _flat(files.read_rows(s, at, _WITH_ID)[1])


@_q(f"SELECT count(*) AS total_questions, 'note' AS novel_summary, '2024-01-01T00:00:00' AS generated_at, false AS has_key FROM ({_ONCE.format(k='q_id', t='questions')})")
def read_back_metadata(s, d):
    """The header of a question set after its summary was added."""
    at = _place(s, "metadata")
    files.write_question_set(_question_rows(s, d), at, "2024-01-01T00:00:00", "n", config={"api_key": "x", "model": "m"})
    files.update_summary(s, at, "note", _WITH_ID)
    m = files.read_metadata(s, at)
    return s.createDataFrame([(m["total_questions"], m["novel_summary"], m["generated_at"], "api_key" in json.dumps(m))], "total_questions bigint, novel_summary string, generated_at string, has_key boolean")


@_q(f"SELECT position.start_pos AS start_pos, position.end_pos AS end_pos, count(*) AS n FROM ({_ONCE.format(k='q_id', t='questions')}) WHERE position.start_pos IS NOT NULL AND position.end_pos IS NOT NULL GROUP BY ALL")
def read_back_positions(s, d):
    """Positions read tolerantly."""
    at = _place(s, "positions")
    files.write_rows(_question_rows(s, d), at, {"a": 1})
    return files.read_positions(s, at)[0].groupBy("start_pos", "end_pos").agg(F.count("*").alias("n"))


_PLACED = f"(SELECT r.*, q.position FROM ({_ONCE.format(k='result_id', t='results')}) r JOIN ({_ONCE.format(k='q_id', t='questions')}) q ON q.q_id = r.q_id)"


def _result_rows(s, d) -> DataFrame:
    q = _question_rows(s, d).select("q_id", "position")
    return _once(s, d, "results", "result_id").join(q, "q_id").select("result_id", "position", F.col("score").cast("string").alias("score"), "depth_bin", "test_context_length", "parsing_status")


@_q(f"SELECT position.start_pos AS start_pos, position.end_pos AS end_pos, score, count(*) AS n FROM {_PLACED} WHERE position.start_pos IS NOT NULL AND position.end_pos IS NOT NULL AND score IS NOT NULL GROUP BY ALL")
def read_back_scores(s, d):
    """Results read tolerantly, their scores written as text."""
    at = _place(s, "scores")
    files.write_results(_result_rows(s, d), at, "2024-01-01", "legacy", order="result_id")
    return files.read_scores(s, at)[0].groupBy("start_pos", "end_pos", "score").agg(F.count("*").alias("n"))


@_q(f"SELECT depth_bin, test_context_length, score, count(*) AS n FROM {_PLACED} WHERE depth_bin IS NOT NULL AND test_context_length IS NOT NULL AND score IS NOT NULL GROUP BY ALL")
def read_back_depth_scores(s, d):
    """Depth results read tolerantly."""
    at = _place(s, "depths")
    files.write_results(_result_rows(s, d), at, "2024-01-01", "depth", order="result_id")
    return files.read_depth_scores(s, at).groupBy("depth_bin", "test_context_length", "score").agg(F.count("*").alias("n"))


_VAL = "SELECT DISTINCT ON (q_id) * FROM (SELECT DISTINCT ON (validation_id) * FROM validations ORDER BY validation_id) ORDER BY q_id, validation_id"


@_q(f"SELECT q_id, v.is_valid AS is_valid, array_to_string(v.failure_reasons, '|') AS reasons, v.confidence AS confidence, v.evidence AS evidence, v.evidence_similarity AS similarity FROM ({_ONCE.format(k='q_id', t='questions')}) q JOIN ({_VAL}) v USING (q_id) WHERE v.is_valid")
def read_back_valid_questions(s, d):
    """Questions with their first validation, of which only the valid ones are written, and read back with all nested fields."""
    fields = [f.name for f in VALIDATED_QUESTION["validation"].dataType.fields]
    first = _once(s, d, "validations", "validation_id").where("q_id is not null").groupBy("q_id").agg(F.min_by(F.struct(*fields), "validation_id").alias("validation"))
    at = _place(s, "validated")
    files.write_validations(_question_rows(s, d).join(first, "q_id"), at, "2024-01-01", {"model_name": "m"}, True, "n")
    rows = files.read_rows(s, at, T.StructType([T.StructField("question", T.StringType()), *VALIDATED_QUESTION.fields[1:]]))[1]
    ids = rows.select(F.get_json_object("raw", "$.q_id").cast("bigint").alias("q_id"), "validation.*")
    return ids.select("q_id", "is_valid", F.array_join("failure_reasons", "|").alias("reasons"), "confidence", "evidence", F.col("evidence_similarity").alias("similarity"))


@_q("SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(length(CASE WHEN len(p) > 3 THEN array_to_string(p[1:3], chr(10)) || chr(10) ELSE text END)) AS BIGINT) AS head_characters FROM (SELECT text || chr(10) AS text, string_split(text || chr(10), chr(10)) AS p FROM documents WHERE kind = 'summary' AND text IS NOT NULL AND NOT contains(text, chr(13)))")
def read_back_texts(s, d):
    """Summaries written as one text file each, with a line end, and read whole and by their first three lines."""
    at = _place(s, "texts")
    docs = table(s, d, "documents").where("kind = 'summary' and text is not null and not contains(text, '\\r')")
    docs.select("doc_id", F.col("text").alias("value")).write.partitionBy("doc_id").text(at)
    whole, head = (f(s, f"{at}/doc_id=*") for f in (files.read_text, lambda s, p: files.read_head(s, p, 3)))
    a = whole.agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("characters"))
    b = head.agg(F.sum(F.length(head.columns[1])).alias("head_characters"))
    return a.join(b, F.lit(True))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
