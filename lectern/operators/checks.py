"""Checks before anything is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.rules import fits


def precheck(questions: DataFrame, ignore_invalid: bool = False, skip: bool = False, has: str = "has_validation", valid: str = "is_valid") -> DataFrame:
    """The questions to ask. Questions that were never validated are an error; invalid ones are an error, or left out with
    ``ignore_invalid``; nothing left is an error; ``skip`` takes all as they are."""
    if skip:
        return questions
    c = questions.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(has), F.lit(False))).alias("missing"), F.count_if(F.col(has) & ~F.coalesce(F.col(valid), F.lit(False))).alias("bad")).first()
    if c["missing"]:
        raise ValueError(f"{c['missing']} questions have not been validated")
    if c["bad"] and not ignore_invalid:
        raise ValueError(f"{c['bad']} questions are not valid")
    if c["n"] - c["bad"] <= 0:
        raise ValueError("no valid question is left")
    return questions.where(F.col(valid))


def precheck_report(questions: DataFrame, validations: DataFrame, key: str = "q_id", valid: str = "is_valid") -> DataFrame:
    """(key, has_validation, is_valid, problem): what :func:`precheck` would say of each question: 'not validated', 'not valid'
    or null. A question is valid when one of its validations is; is_valid is null without any."""
    v = validations.groupBy(key).agg(F.max(F.coalesce(valid, F.lit(False))).alias("is_valid"))
    out = questions.select(key).join(v, key, "left").withColumn("has_validation", F.col("is_valid").isNotNull())
    return out.select(key, "has_validation", "is_valid", F.when(~F.col("has_validation"), "not validated").when(~F.col("is_valid"), "not valid").alias("problem"))


def fitting(questions: DataFrame, end_pos: str, padding: int, length: int) -> DataFrame:
    return questions.where(fits(F.col(end_pos), padding, length))


def length_report(questions: DataFrame, lengths: list[int], novel_tokens: int | str, padding: int, start: str = "start_pos", end: str = "end_pos", by: str | None = None) -> DataFrame:
    """The bounds of positive ends and whether the lengths can be tested: the longest within the novel, the shortest at least
    the first end plus padding, and some question whose padded evidence is shorter than some length. One row, or one for each
    value of ``by``; then ``novel_tokens`` names the column of the novel's length."""
    positive = F.col(end) > 0
    span = F.col(end) - F.col(start) + 2 * padding
    some = F.exists(F.array(*map(F.lit, lengths)), lambda x: x > span)
    novel = F.max(novel_tokens) if by else F.max(F.lit(novel_tokens))
    c = questions.groupBy(*([by] if by else [])).agg(F.min(F.when(positive, F.col(end))).alias("min_end"), F.max(F.when(positive, F.col(end))).alias("max_end"), F.count_if(F.coalesce(some, F.lit(False))).alias("testable"), novel.alias("novel_"))
    error = (
        F.when(F.col("novel_").isNull() & F.lit(by is not None), "the novel has no tokens")
        .when(F.lit(max(lengths)) > (F.col("novel_") if by else F.lit(novel_tokens)), "a context length exceeds the novel")
        .when(F.col("min_end").isNull(), "no question has a position")
        .when(F.lit(min(lengths)) < F.col("min_end") + padding, "the shortest context length ends before the first question")
        .when(F.col("testable") == 0, "no question fits any context length")
    )
    return c.withColumn("error", error).drop("novel_")


def check_lengths(questions: DataFrame, lengths: list[int], novel_tokens: int, padding: int, **names: str) -> None:
    error = length_report(questions, lengths, novel_tokens, padding, **names).first()["error"]
    if error:
        raise ValueError(error)


def estimated_novel_length(questions: DataFrame, end: str = "end_pos", default: int = 100_000) -> DataFrame:
    """One row: 1.2 times the last end, or the default without any."""
    top = F.max(F.when(F.col(end) > 0, F.col(end)))
    return questions.agg(F.coalesce((top * 1.2).cast("bigint"), F.lit(default).cast("bigint")).alias("novel_length"))
