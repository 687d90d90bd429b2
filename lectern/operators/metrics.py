"""Summaries of results and validations, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.schema import FAILED


def _mean_if(value: Column, cond: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))


def scored(results: DataFrame) -> DataFrame:
    """``results`` with category, report_score, precision, recall and f1_score of each row."""
    k, c, m, s = (F.col(x) for x in ("question_type", "correct_answer", "model_answer", "parsing_status"))
    p, r, f1 = A.set_scores(c, m)
    return results.withColumns({"category": A.category(k, c, m, s), "report_score": A.report_score(k, c, m, s), "precision": p, "recall": r, "f1_score": f1})


def all_metrics(results: DataFrame, *by: str) -> DataFrame:
    """Counts by type and category, accuracy of single-choice rows (lists equal in order, whatever the status), mean precision,
    recall and F1 of multiple-choice rows, and mean report score; for all rows or for each value of ``by``. Without rows all
    are 0."""
    s = scored(results)
    kind, cat = F.col("question_type"), F.col("category")
    single, multi = kind.eqNullSafe("single_choice"), kind.eqNullSafe("multiple_choice")
    equal = F.coalesce(F.col("correct_answer") == F.col("model_answer"), F.lit(False)).cast("double")
    return s.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(single).alias("single_choice"),
        F.count_if(multi).alias("multiple_choice"),
        F.count_if(kind.eqNullSafe("negative_question")).alias("negative_question"),
        *(F.count_if(cat == c).alias(c) for c in ("correct", "partially_correct", "incorrect", "parsing_error")),
        _mean_if(equal, single).alias("single_accuracy"),
        *(_mean_if(F.col(c), multi).alias(f"multi_{c}") for c in ("precision", "recall", "f1_score")),
        F.coalesce(F.avg("report_score"), F.lit(0.0)).alias("mean_score"),
    )


def category_counts(results: DataFrame, *by: str) -> DataFrame:
    cat = F.col("category")
    return scored(results).groupBy(*by).agg(*(F.count_if(cat == c).alias(c) for c in ("correct", "partially_correct", "incorrect", "parsing_error")))


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Rows by status and type and the mean stored score."""
    status, kind = F.col("parsing_status"), F.col("question_type")
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        *(F.count_if(status == s).alias(s) for s in ("success", "regex_extracted", *FAILED)),
        F.count_if(kind == "single_choice").alias("single_choice"),
        F.count_if(kind == "multiple_choice").alias("multiple_choice"),
        F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("mean_score"),
    )


def depth_summary(results: DataFrame) -> DataFrame:
    """(depth_bin, test_context_length, n, mean_score): by depth, then by length; missing ones are 'unknown' and 0."""
    rows = results.select(F.coalesce("depth_bin", F.lit("unknown")).alias("depth_bin"), F.coalesce("test_context_length", F.lit(0)).cast("bigint").alias("test_context_length"), F.coalesce("score", F.lit(0.0)).alias("score"))
    sets = rows.groupingSets([[F.col("depth_bin")], [F.col("test_context_length")]], "depth_bin", "test_context_length")
    return sets.agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def no_reference_summary(results: DataFrame, *by: str) -> DataFrame:
    """Mean score, share of one-answer rows that score 1, mean F1 of rows with several answers."""
    kind = F.col("question_type")
    single, multi = kind.eqNullSafe("single_choice"), kind.eqNullSafe("multiple_choice")
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(single).alias("single_choice"),
        F.count_if(multi).alias("multiple_choice"),
        F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("mean_score"),
        _mean_if((F.coalesce("score", F.lit(0.0)) == 1.0).cast("double"), single).alias("single_accuracy"),
        _mean_if(F.coalesce(F.try_element_at("metrics", F.lit("f1_score")), F.lit(0.0)), multi).alias("multi_f1"),
    )


def validation_stats(validations: DataFrame, *by: str) -> DataFrame:
    """Passed, failed, pass rate, and how many rows fail each check, independently."""
    no = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    return validations.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_valid")).alias("passed"),
        no("is_valid").alias("failed"),
        F.coalesce(F.avg(F.coalesce(F.col("is_valid"), F.lit(False)).cast("double")), F.lit(0.0)).alias("pass_rate"),
        no("answer_matches").alias("answer_mismatch"),
        no("evidence_found").alias("evidence_not_found"),
        no("is_answerable").alias("not_answerable"),
        F.count_if(F.coalesce(F.col("confidence"), F.lit("low")) == "low").alias("low_confidence"),
    )


def error_rate(results: DataFrame, *by: str) -> DataFrame:
    """Share of rows that are not fully correct."""
    bad = F.col("category").isin("incorrect", "partially_correct", "parsing_error")
    return scored(results).groupBy(*by).agg(F.count_if(bad).alias("errors"), F.count("*").alias("total"), F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("error_rate"))


def generation_summary(sets: DataFrame, questions: DataFrame, *by: str) -> DataFrame:
    """Questions asked for and got, success rate, and questions by type, for each value of ``by`` in ``sets``."""
    q = questions.groupBy("set_id").agg(F.count("*").alias("got"), F.count_if(F.col("question_type") == "single_choice").alias("single"), F.count_if(F.col("question_type") == "multiple_choice").alias("multiple"))
    zero = F.lit(0)
    joined = sets.join(q, "set_id", "left")
    asked = F.sum(F.coalesce("total_questions", zero))
    got = F.sum(F.coalesce("got", zero))
    return joined.groupBy(*by).agg(asked.cast("bigint").alias("asked"), got.alias("got"), F.coalesce(F.try_divide(got.cast("double"), asked.cast("double")), F.lit(0.0)).alias("success_rate"), F.sum(F.coalesce("single", zero)).alias("single_choice"), F.sum(F.coalesce("multiple", zero)).alias("multiple_choice"))
