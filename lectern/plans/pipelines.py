"""Whole runs: generating questions, validating them, testing a model, reports. Model replies come from a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.functions import replies, rules, text, tokens
from lectern.functions.evidence import match_evidence
from lectern.operators import checks, context, recovery, sequence
from lectern.plans.provider import Provider, TableProvider, request_key
from lectern.schema import QUESTION

ASK = 'Read the text and answer the question.\n\n{context}\n\nQuestion: {question}\n{choices}\n\nReply as JSON: {"answer": ["key"]}'
ASK_WITHOUT_TEXT = 'Answer from memory.\n\nQuestion: {question}\n{choices}\n\nReply as JSON: {"answer": ["key"]}'
VALIDATE = 'Text:\n{context}\n\nQuestion: {question}\n{choices}\n\nReply as JSON with answer, evidence, is_answerable, confidence and reasoning.'
GENERATE = 'Write one {question_type} question about the text.\n\n{context}\n\nReply as JSON with question, question_type, choice and answer.'
SUMMARIZE = "Summarize the beginning of this novel.\n\n{excerpt}"


def _prompt(template: str, ctx: Column | None = None) -> Column:
    return text.render(template, context=ctx if ctx is not None else F.lit(""), question=F.col("question"), choices=text.choice_lines(F.col("choice")))


def scored_replies(asked: DataFrame) -> DataFrame:
    """Rows with ``reply`` as results: answers, status (no reply: 'timeout' or, after an exception, 'error'), score, metrics."""
    parsed = asked.withColumn("parsed_", replies.parse_answer("reply"))
    status = F.when(F.col("call_error").startswith("Exception"), "error").when(F.col("reply").isNull(), "timeout").otherwise(F.col("parsed_.status"))
    out = parsed.withColumns({"parsing_status": status, "correct_answer": F.col("answer"), "model_answer": F.when(F.col("reply").isNull(), F.array().cast("array<string>")).otherwise(F.col("parsed_.answer")), "raw_answer": F.col("reply")})
    k, c, m = F.col("question_type"), F.col("correct_answer"), F.col("model_answer")
    dead = F.col("parsing_status").isin("error", "timeout", "context_build_error")
    return out.withColumns({"score": F.when(dead, 0.0).otherwise(A.test_score(k, c, m)), "metrics": F.when(dead, F.create_map().cast("map<string,double>")).otherwise(A.test_metrics(k, c, m))}).drop("parsed_", "reply")


def run_first_tokens(questions: DataFrame, novel: DataFrame, provider: Provider, length: int, padding: int = 500) -> DataFrame:
    """One text for all: the first ``length`` tokens of the novel; questions beyond it are not asked."""
    fit = checks.fitting(questions.withColumn("end_", F.col("position.end_pos")), "end_", padding, length).drop("end_")
    with_text = fit.join(novel.select("novel_id", tokens.decode(tokens.first_tokens(F.col("tokens"), length)).alias("context")), "novel_id")
    return scored_replies(provider.ask(with_text.withColumn("prompt", _prompt(ASK, F.col("context"))).drop("context"), F.col("prompt"))).drop("prompt")


def run_at_depths(questions: DataFrame, novel: DataFrame, provider: Provider, lengths: list[int], mode: str = "uniform", depth: float | None = None, padding: int = 500, idx: str = "idx") -> DataFrame:
    """Each question in a text of a scheduled length with its passage at a scheduled depth. Rows whose text can't be built come
    out with status 'context_build_error' and the depth aimed at; all others with the depth reached."""
    planned = sequence.schedule(questions, mode, lengths, depth, idx).join(novel.select("novel_id", "tokens"), "novel_id")
    built = context.build_contexts(planned, F.col("position.start_pos"), F.col("position.end_pos"), F.col("target_depth"), F.col("context_length"), "tokens", padding=padding).drop("tokens")
    good = built.where("built.success").withColumn("prompt", _prompt(ASK, F.col("context")))
    done = scored_replies(provider.ask(good.drop("context"), F.col("prompt"))).drop("prompt").withColumn("depth", F.col("built.actual_depth"))
    empty = F.array().cast("array<string>")
    bad = built.where("not built.success").drop("context").withColumns({"call_error": F.lit(None).cast("string"), "parsing_status": F.lit("context_build_error"), "correct_answer": F.col("answer"), "model_answer": empty, "raw_answer": F.lit(None).cast("string"), "score": F.lit(0.0), "metrics": F.create_map().cast("map<string,double>"), "depth": F.col("target_depth")})
    return done.unionByName(bad).withColumn("test_context_length", F.col("context_length")).withColumn("error_message", F.coalesce("built.error_message", "call_error")).drop("built", "call_error")


def run_without_text(questions: DataFrame, provider: Provider) -> DataFrame:
    """Each question without any text; depths are relative to 1.2 times the last position."""
    n = checks.estimated_novel_length(questions.withColumn("end_", F.col("position.end_pos")), "end_")
    rows = questions.join(F.broadcast(n), F.lit(True)).withColumn("prompt", _prompt(ASK_WITHOUT_TEXT))
    out = scored_replies(provider.ask(rows, F.col("prompt"))).drop("prompt")
    d = F.least(F.lit(1.0), F.coalesce(F.col("position.start_pos"), F.lit(0)) / F.col("novel_length"))
    return out.withColumns({"depth": d, "depth_bin": rules.depth_label(d), "test_mode": F.lit("no_reference")}).drop("novel_length")


def run_again(previous: DataFrame, questions: DataFrame, run, on: str = "question", order: str = "idx", key: str = "result_key") -> DataFrame:
    """``previous`` with its failed rows asked again by ``run`` (questions -> results with the same key) and replaced."""
    retry = recovery.retry_rows(previous.select(on, "parsing_status").distinct(), questions, on, order).select(on, "asked.*").dropDuplicates([on])
    new = run(retry).withColumn("again_", F.monotonically_increasing_id())
    return recovery.merge_recovered(previous, new, key, order, "again_")


def validate_questions(questions: DataFrame, novel: DataFrame, provider: Provider, threshold: float = 0.8, confidence: str = "medium") -> DataFrame:
    """``questions`` with ``validation``: the model's answer from the passage alone, whether it agrees, whether its evidence is
    in the passage, and why a question fails."""
    span = tokens.token_slice(F.col("tokens"), F.col("position.start_pos"), F.col("position.end_pos"))
    rows = questions.join(novel.select("novel_id", "tokens"), "novel_id").withColumn("passage", tokens.decode(span)).drop("tokens")
    asked = provider.ask(rows.withColumn("prompt", text.render(VALIDATE, context=F.col("passage"), question=F.col("question"), choices=text.sorted_choice_lines(F.col("choice")))), F.col("prompt")).drop("prompt")
    read = asked.withColumn("v", replies.parse_verdict("reply")).withColumn("quote_", F.col("v.evidence"))
    found = match_evidence(read, "quote_", "passage", threshold)
    same = A.matches(F.col("answer"), F.col("v.answer"), F.col("question_type"))
    sure = F.col("v.confidence")
    reasons = F.when(F.col("v.error").isNotNull(), F.array(F.col("v.error"))).otherwise(rules.failure_reasons(same, F.col("evidence_found"), F.col("v.is_answerable"), sure, confidence))
    ok = F.size(reasons) == 0
    validation = F.struct(ok.alias("is_valid"), F.col("v.answer").alias("model_answer"), same.alias("answer_matches"), F.col("v.evidence").alias("evidence"), "evidence_found", "evidence_similarity", F.col("v.is_answerable").alias("is_answerable"), sure.alias("confidence"), reasons.alias("failure_reasons"), F.col("v.reasoning").alias("reasoning"))
    return found.withColumn("validation", validation).select(*questions.columns, "validation")


def generate_questions(positions: DataFrame, novel: DataFrame, provider: Provider, window: int = 1000, attempts: int = 3, seed: int = 0) -> DataFrame:
    """One question for each (novel_id, position): a text around the position, a prompt for each attempt, and the first attempt
    whose reply reads as a valid question; positions without one are left out."""
    from lectern.operators.sampling import random_choice

    w = tokens.aligned_window(window)
    at = positions.join(novel.select("novel_id", "tokens"), "novel_id").withColumn("w", w("tokens", F.col("position"))).drop("tokens")
    tries = at.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    kind = random_choice(F.concat_ws("-", "novel_id", "position", "attempt"), ("single_choice", "multiple_choice"), seed)
    asked = provider.ask(tries.withColumn("prompt", text.render(GENERATE, context=tokens.decode("w.tokens"), question_type=kind)).select("novel_id", "position", "attempt", F.col("w.start").alias("start_pos"), F.col("w.end").alias("end_pos"), "prompt"), F.col("prompt"))
    q = asked.withColumn("q", F.from_json(replies.parse_object("reply"), QUESTION)).withColumn("place", F.struct("start_pos", "end_pos"))
    good = q.where(rules.question_error(F.col("q.question"), F.col("q.question_type"), F.col("q.choice"), F.col("q.answer"), F.col("place")).isNull())
    first = good.groupBy("novel_id", F.col("position").alias("sampled_at")).agg(F.min_by(F.struct("q.question", "q.question_type", F.to_json("q.choice").alias("choice"), "q.answer", F.col("place").alias("position")), "attempt").alias("f"))
    return first.select("novel_id", "sampled_at", "f.question", "f.question_type", F.from_json("f.choice", "map<string,string>").alias("choice"), "f.answer", "f.position")


def summarize(novels: DataFrame, provider: Provider, lines: int = 100) -> DataFrame:
    """(novel_id, summary) from the first lines of each novel's ``text``; an error where there is no reply."""
    head = F.array_join(F.slice(F.split("text", "(?<=\n)"), 1, lines), "")
    asked = provider.ask(novels.select("novel_id", text.render(SUMMARIZE, excerpt=head).alias("prompt")), F.col("prompt"))
    return asked.select("novel_id", F.when(F.col("reply").isNull(), F.raise_error(F.lit("no summary"))).otherwise(F.trim("reply")).alias("summary"))


def replay(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Stored replies run through the pipeline again: (result_id, parsing_status, score, answers)."""
    rows = results.select("result_id", "q_id", "question_type", F.col("correct_answer").alias("answer"), "raw_answer").join(questions.select("q_id", "question", "choice"), "q_id")
    rows = rows.withColumn("prompt", F.concat_ws("\n", F.col("result_id").cast("string"), _prompt(ASK_WITHOUT_TEXT)))
    known = rows.where("raw_answer is not null").select(request_key(F.col("prompt")).alias("request_key"), F.col("raw_answer").alias("reply"))
    out = scored_replies(TableProvider(known).ask(rows.drop("raw_answer"), F.col("prompt")))
    return out.select("result_id", "parsing_status", F.round("score", 9).alias("score"), F.array_join("model_answer", ",").alias("answers"))
