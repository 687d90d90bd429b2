import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import tokens
from lectern.plans import pipelines
from lectern.plans.provider import CallProvider, Retryable, TableProvider, probe, request_key, retry_delays

Q = "idx bigint, novel_id bigint, question string, question_type string, choice map<string,string>, answer array<string>, position struct<start_pos:bigint,end_pos:bigint>"


@pytest.fixture(scope="module")
def novel(spark):
    t = " ".join(f"word{i}{'.' if i % 10 == 9 else ''}" for i in range(400))
    return spark.createDataFrame([(1, t)], "novel_id bigint, text string").withColumn("tokens", tokens.encode("text"))


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(k, 1, f"which {k}?", "single_choice" if k % 2 else "multiple_choice", {"a": "x", "b": "y", "c": "z", "d": "w"}, ["a"] if k % 2 else ["a", "b"], (k * 30, k * 30 + 5)) for k in range(6)]
    return spark.createDataFrame(rows, Q)


def test_first_tokens_and_scores(questions, novel):
    r = {x["idx"]: x for x in pipelines.run_first_tokens(questions, novel, CallProvider(lambda p: '{"answer": ["a"]}', delay=0), 100, 10).collect()}
    assert set(r) == {0, 1, 2} and r[1]["score"] == 1.0 and r[0]["score"] == pytest.approx(2 / 3) and r[0]["metrics"]["recall"] == 0.5


def test_depths(questions, novel):
    def reply(prompt):
        if "which 3?" in prompt:
            raise ValueError("boom")
        return None if "which 4?" in prompt else 'well {"answer": ["a"]}'

    r = {x["idx"]: x for x in pipelines.run_at_depths(questions, novel, CallProvider(reply, delay=0), [60, 12], padding=5).collect()}
    assert len(r) == 6
    assert r[5]["parsing_status"] == "context_build_error" and r[5]["depth"] == 0.0 and r[5]["test_context_length"] == 12
    assert r[3]["parsing_status"] == "error" and r[4]["parsing_status"] == "timeout" and r[4]["score"] == 0.0 and r[1]["parsing_status"] == "regex_extracted"
    assert 0 < r[1]["depth"] < 0.25


def test_no_text_and_retry(questions):
    seen = {}

    def reply(prompt):
        if not seen.setdefault(prompt, 0):
            seen[prompt] += 1
            raise Retryable("later")
        return '{"answer": ["a"]}'

    r = pipelines.run_without_text(questions, CallProvider(reply, tasks=1, at_once=1, delay=0)).collect()
    assert len(r) == 6 and all(x["test_mode"] == "no_reference" and x["parsing_status"] == "success" for x in r) and max(x["depth"] for x in r) < 0.84
    assert retry_delays(4) == [1.0, 2.0, 4.0]
    assert probe(lambda p: "a b c", lambda t: len(t.split()))["tokens"] == 3


def test_validation(questions, novel):
    def reply(prompt):
        if "which 2?" in prompt:
            return "nothing"
        return json.dumps({"answer": "a, b" if "which 0?" in prompt else ["A"], "evidence": prompt.split("Text:\n")[1].split("\n")[0], "is_answerable": "which 5?" not in prompt, "confidence": "low" if "which 3?" in prompt else "High"})

    v = {x["idx"]: x["validation"] for x in pipelines.validate_questions(questions, novel, CallProvider(reply, delay=0)).collect()}
    assert v[0]["is_valid"] and v[1]["is_valid"] and v[2]["failure_reasons"] == ["Failed to parse reply"]
    assert v[3]["failure_reasons"] == ["confidence too low"] and v[4]["failure_reasons"] == ["answer mismatch"] and v[5]["failure_reasons"] == ["not answerable"]


def test_generation(spark, novel):
    def reply(prompt):
        kind = prompt.split()[2]
        n = 2 if kind == "multiple_choice" else 4
        return "```json\n" + json.dumps({"question": "q", "question_type": kind, "choice": dict(zip("abcd"[:n], "wxyz")), "answer": ["a"]}) + "\n```"

    p = spark.createDataFrame([(1, 50), (1, 300)], "novel_id bigint, position bigint")
    got = pipelines.generate_questions(p, novel, CallProvider(reply, delay=0), 40, 8).collect()
    assert len(got) == 2 and all(g["question_type"] == "single_choice" and g["position"]["end_pos"] > g["position"]["start_pos"] and g["choice"]["d"] == "z" for g in got)
    s = pipelines.summarize(novel.select("novel_id", "text"), CallProvider(lambda p: " short ", delay=0)).collect()
    assert s[0]["summary"] == "short"


def test_table_provider_and_run_again(spark, questions):
    rows = questions.withColumn("prompt", F.concat(F.lit("p"), F.col("idx")))
    known = rows.where("idx < 2").select(request_key(F.col("prompt")).alias("request_key"), F.lit("r").alias("reply"))
    got = {r["idx"]: (r["reply"], r["call_error"]) for r in TableProvider(known).ask(rows, F.col("prompt")).collect()}
    assert got[0] == ("r", None) and got[5] == (None, "no reply")
    prev = questions.select("question", F.col("question").alias("result_key"), "idx", F.when(F.col("idx") == 2, "timeout").otherwise("success").alias("parsing_status"), F.lit(0.0).alias("score"))
    run = lambda q: q.select("question", F.col("question").alias("result_key"), F.lit("success").alias("parsing_status"), F.lit(1.0).alias("score"))
    out = {r["idx"]: r["score"] for r in pipelines.run_again(prev, questions, run).collect()}
    assert out[2] == 1.0 and sum(out.values()) == 1.0
