import json

import pytest

from lectern.operators.record_triage import classify_records, loaded_records


def csv(*fields):
    return ",".join('"' + f.replace('"', '""') + '"' for f in fields)


C, A = json.dumps({"a": "x, y", "b": 'say "hi"'}), '["a"]'
CASES = [
    (csv("q", "t", C, A, "1", "2"), None),
    (csv("line\nbreak", "t", C, A, "1", "1") + "\r", None),
    ("q,t," + csv(C) + "," + csv(A) + ",1,2", None),
    ('q" x,t,' + csv(C, A) + ",1,2", "quoting"),
    ('"q"x,t,' + csv(C, A) + ",1,2", "quoting"),
    ('"q,t,1,2', "quoting"),
    ("a,b", "column_count"),
    (csv("q", "t", C, A, "1", "2", "3"), "column_count"),
    ("a,b,c,d,e,f,g,", "column_count"),
    (csv(" 　\t", "t", "{", A, "1", "2"), "question"),
    (csv("", "t", C, A, "1", "2"), "question"),
    (csv("q", "t", '{"a": "x"}', A, "1", "2"), "choice"),
    (csv("q", "t", '{"a": "x", "a": "y"}', A, "1", "2"), "choice"),
    (csv("q", "t", '{"a": "x", "b": 1}', A, "1", "2"), "choice"),
    (csv("q", "t", '{"a": "x", "b": "y",}', A, "1", "2"), "choice"),
    (csv("q", "t", '{"a": "x", "b": NaN}', A, "1", "2"), "choice"),
    (csv("q", "t", '["a", "b"]', A, "1", "2"), "choice"),
    (csv("q", "t", "", A, "1", "2"), "choice"),
    (csv("q", "t", C, "[]", "1", "2"), "answer"),
    (csv("q", "t", C, '["c"]', "1", "2"), "answer"),
    (csv("q", "t", C, '["A"]', "1", "2"), "answer"),
    (csv("q", "t", C, '"a"', "1", "2"), "answer"),
    (csv("q", "t", C, "null", "1", "2"), "answer"),
    (csv("q", "t", C, '["a", 1]', "1", "2"), "answer"),
    (csv("q", "t", C, A, "-1", "2"), "position"),
    (csv("q", "t", C, A, "3", "2"), "position"),
    (csv("q", "t", C, A, "1_0", "20"), "position"),
    (csv("q", "t", C, A, " 1", "2"), "position"),
    (csv("q", "t", C, A, "", "2"), "position"),
    (csv("q", "t", C, A, "١", "2"), "position"),
    (csv("q", "t", C, A, "1", "99999999999999999999"), "position"),
    (csv("q" * 200_000 + '"' * 50_000, "t", C, A, "1", "2"), None),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(k, 2 + k, raw, "clash") for k, (raw, _) in enumerate(CASES)]
    rows += [rows[0], (900, 1, "question,question_type,choice,answer,start_pos,end_pos", ""), (901, 5, "  ", ""), (902, 6, "\r", ""), (903, 7, None, "")]
    df = spark.createDataFrame(rows, "line_id bigint, line_no bigint, raw_line string, question string")
    return classify_records(df).collect(), df


def test_each_reason(got):
    assert {r["line_id"]: r["reason"] for r in got[0]} == {k: reason for k, (_, reason) in enumerate(CASES)}
    assert len(got[0]) == len(CASES)


def test_typed_values(got):
    rows = {r["line_id"]: r for r in loaded_records(got[1]).collect()}
    assert rows[0]["choice"] == {"a": "x, y", "b": 'say "hi"'} and rows[0]["answer"] == ["a"] and tuple(rows[0]["position"]) == (1, 2)
    assert rows[1]["question"] == "line\nbreak"
    assert rows[31]["question"] == "q" * 200_000 + '"' * 50_000


def test_empty_table(spark):
    assert classify_records(spark.createDataFrame([], "line_id bigint, line_no bigint, raw_line string")).count() == 0
