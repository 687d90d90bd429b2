"""Comparing, classifying and scoring answers; all built from expressions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schema import FAILED


def _list(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.coalesce(a, F.array().cast("array<string>"))


def same_set(a: Column | str, b: Column | str) -> Column:
    """Whether two lists hold the same values; null is the empty list."""
    a, b = _list(a), _list(b)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Number of different values in both lists."""
    return F.size(F.array_intersect(_list(a), _list(b)))


def set_scores(correct: Column | str, model: Column | str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of the model's values; 0 where a side is empty."""
    n, m, c = overlap(correct, model), F.size(F.array_distinct(_list(model))), F.size(F.array_distinct(_list(correct)))
    p = F.when(m > 0, n / m).otherwise(0.0)
    r = F.when(c > 0, n / c).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0)


def no_answer(status: Column | str, model: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.eqNullSafe("parsing_error") | (F.size(_list(model)) == 0)


def category(kind: Column, correct: Column, model: Column, status: Column) -> Column:
    """correct, partially_correct, incorrect or parsing_error. An empty answer is a parsing error whatever its status."""
    equal = same_set(correct, model)
    return (
        F.when(no_answer(status, model), "parsing_error")
        .when(equal, "correct")
        .when(kind.eqNullSafe("multiple_choice") & (overlap(correct, model) > 0), "partially_correct")
        .otherwise("incorrect")
    )


def report_score(kind: Column, correct: Column, model: Column, status: Column) -> Column:
    """Score of a report: equal sets for one-answer and negative questions, F1 for several answers, 0 for other types."""
    return (
        F.when(no_answer(status, model), 0.0)
        .when(kind.isin("single_choice", "negative_question"), same_set(correct, model).cast("double"))
        .when(kind == "multiple_choice", set_scores(correct, model)[2])
        .otherwise(0.0)
    )


def test_score(kind: Column, correct: Column, model: Column) -> Column:
    """Score at test time: equal lists for one answer, F1 for several, 0 for all other types."""
    return (
        F.when(kind == "single_choice", (_list(correct) == _list(model)).cast("double"))
        .when(kind == "multiple_choice", F.when(F.size(_list(model)) == 0, 0.0).otherwise(set_scores(correct, model)[2]))
        .otherwise(0.0)
    )


def test_metrics(kind: Column, correct: Column, model: Column) -> Column:
    """Map of precision, recall and f1_score for several answers, else empty."""
    p, r, f1 = set_scores(correct, model)
    several = F.create_map(F.lit("precision"), p, F.lit("recall"), r, F.lit("f1_score"), f1)
    return F.when(kind == "multiple_choice", several).otherwise(F.create_map().cast("map<string,double>"))


def color(score: Column, status: Column) -> Column:
    """Marker color of a result."""
    return F.when(status.eqNullSafe("parsing_error"), "gray").when(score == 1.0, "green").when(score > 0, "yellow").otherwise("red")


def normalized(a: Column | str) -> Column:
    """Lower-cased, stripped, non-empty answers in order, repeats kept."""
    strip = lambda x: F.regexp_replace(F.lower(x), r"(?U)^\s+|\s+$", "")
    return F.array_sort(F.filter(F.transform(_list(a), strip), lambda x: x.isNotNull() & (x != "")))


def matches(labelled: Column, model: Column, kind: Column) -> Column:
    """Whether two answers agree by the rules of the question type."""
    a, b = normalized(labelled), normalized(model)
    return F.when(kind == "multiple_choice", same_set(a, b)).otherwise(a == b)


def valid_answer(answer: Column, keys: Column) -> Column:
    """Whether an answer is not empty and all of it among the keys."""
    return (F.size(_list(answer)) > 0) & (F.size(F.array_except(_list(answer), _list(keys))) == 0)


def failed(status: Column) -> Column:
    """Whether a result has to be run again."""
    return F.coalesce(status.isin(*FAILED), F.lit(False))
