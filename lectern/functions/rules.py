"""Rules that questions and validations must meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schema import CONFIDENCE, DEPTH_LABELS, QUESTION_TYPES


def structure_error(question: Column, kind: Column, choice: Column, answer: Column, position: Column) -> Column:
    """The first structural fault of a typed question, or null. A null column stands for a missing or wrongly typed field."""
    blank = question.isNull() | question.rlike(r"(?U)^\s*\z")
    start, end = position["start_pos"], position["end_pos"]
    return (
        F.when(blank, "the question is blank")
        .when(kind.isNull(), "the question has no type")
        .when(choice.isNull(), "the question has no choices")
        .when(F.size(choice) < 2, "there are fewer than two choices")
        .when(F.exists(F.map_values(choice), lambda v: v.isNull()), "a choice has no text")
        .when(answer.isNull(), "the question has no answer list")
        .when(F.size(answer) == 0, "the answer list is empty")
        .when(position.isNull(), "the question has no position")
        .when(start.isNull() | end.isNull(), "an end of the position is missing")
        .when(start < 0, "the position starts before the text")
        .when(end < start, "the position ends before it starts")
    )


def raw_structure_error(raw: Column) -> Column:
    """The first structural fault of a question that is still JSON text, or null. Wrongly typed fields are told apart from missing
    ones, which a typed column cannot do. Whole numbers are positions, and so are true and false (1 and 0)."""
    v = F.try_parse_json(raw)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(part(name)), F.lit("VOID"))
    is_a = lambda c, *kinds: F.exists(F.array(*map(F.lit, kinds)), lambda k: c.startswith(k))
    text = F.try_variant_get(v, "$.question", "string")
    choices = F.try_variant_get(v, "$.choice", "map<string,variant>")
    answers = F.try_variant_get(v, "$.answer", "array<variant>")
    whole = lambda name: is_a(kind(name), "BIGINT", "BOOLEAN")
    start, end = (F.coalesce(F.try_variant_get(v, f"$.position.{c}", "bigint"), F.try_variant_get(v, f"$.position.{c}", "boolean").cast("bigint")) for c in ("start_pos", "end_pos"))
    missing = F.lit(None).cast("string")
    for name in ("position", "answer", "choice", "question_type", "question"):
        missing = F.when(part(name).isNull(), f"the field {name} is missing").otherwise(missing)
    return (
        F.when(v.isNull(), "the question is no JSON")
        .when(~is_a(F.schema_of_variant(v), "OBJECT"), "the question is no object")
        .when(missing.isNotNull(), missing)
        .when(kind("question") != "STRING", "the question is no text")
        .when(text.rlike(r"(?U)^\s*\z"), "the question is blank")
        .when(kind("question_type") != "STRING", "the type is no text")
        .when(~is_a(kind("choice"), "OBJECT"), "the choices are no object")
        .when(F.size(choices) < 2, "there are fewer than two choices")
        .when(F.exists(F.map_values(choices), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"), "a choice is no text")
        .when(~is_a(kind("answer"), "ARRAY"), "the answers are no list")
        .when(F.size(answers) == 0, "the answer list is empty")
        .when(~is_a(kind("position"), "OBJECT"), "the position is no object")
        .when(part("position.start_pos").isNull() | part("position.end_pos").isNull(), "an end of the position is missing")
        .when(~whole("position.start_pos") | ~whole("position.end_pos"), "an end of the position is no whole number")
        .when(start < 0, "the position starts before the text")
        .when(end < start, "the position ends before it starts")
    )


def content_error(kind: Column, choice: Column, answer: Column) -> Column:
    """Unknown type, or fewer than two wrong options in a question with several answers; else null."""
    return F.when(~F.coalesce(kind.isin(*QUESTION_TYPES), F.lit(False)), "the type is not known").when((kind == "multiple_choice") & (F.size(choice) - F.size(answer) < 2), "there are fewer than two wrong choices")


def answer_error(choice: Column, answer: Column) -> Column:
    """An answer that is no key of choice; else null."""
    keys = F.coalesce(F.map_keys(choice), F.array().cast("array<string>"))
    return F.when(F.exists(F.coalesce(answer, F.array().cast("array<string>")), lambda a: a.isNull()), "an answer has no text").when(F.size(F.array_except(F.coalesce(answer, F.array().cast("array<string>")), keys)) > 0, "answer is not a choice")


def question_error(question: Column, kind: Column, choice: Column, answer: Column, position: Column) -> Column:
    """The first fault of structure, content or answers, or null."""
    return F.coalesce(structure_error(question, kind, choice, answer, position), content_error(kind, choice, answer), answer_error(choice, answer))


def confidence_rank(confidence: Column) -> Column:
    """0 low, 1 medium, 2 high; 0 for anything else."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence), F.lit(0)) - 1, F.lit(0)).cast("int")


def meets_confidence(confidence: Column, threshold: str = "medium") -> Column:
    return confidence_rank(confidence) >= (CONFIDENCE.index(threshold) if threshold in CONFIDENCE else 0)


def settled_validation(is_valid: Column, similarity: Column, confidence: Column, reasons: Column) -> Column:
    """A validation under its invariants: known confidence, similarity in 0..1, no reasons if valid, one at least if not."""
    reasons = F.coalesce(reasons, F.array().cast("array<string>"))
    return F.struct(
        is_valid.alias("is_valid"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)).alias("evidence_similarity"),
        F.when(confidence.isin(*CONFIDENCE), confidence).otherwise("low").alias("confidence"),
        F.when(is_valid, F.array().cast("array<string>")).when(F.size(reasons) == 0, F.array(F.lit("Unknown validation failure"))).otherwise(reasons).alias("failure_reasons"),
    )


def failure_reasons(answer_matches: Column, evidence_found: Column, answerable: Column, confidence: Column, threshold: str = "medium") -> Column:
    """Why a question is not valid, in fixed order; empty for a valid one."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(no(answer_matches), F.lit("answer mismatch")),
            F.when(no(evidence_found), F.lit("evidence not found")),
            F.when(no(answerable), F.lit("not answerable")),
            F.when(no(meets_confidence(confidence, threshold)), F.lit("confidence too low")),
        )
    )


def depth_label(depth: Column) -> Column:
    """The nearest of 0, 25, 50, 75 and 100 percent; a tie goes to the lower."""
    out = F.when(depth <= 0.125, DEPTH_LABELS[0])
    for most, label in zip((0.375, 0.625, 0.875), DEPTH_LABELS[1:]):
        out = out.when(depth <= most, label)
    return out.otherwise(F.when(depth.isNotNull(), DEPTH_LABELS[4]))


def fits(end_pos: Column, padding: int, length: Column | int) -> Column:
    """Whether a question's passage and its padding lie within the first ``length`` tokens; a missing end counts as 0."""
    return F.coalesce(end_pos, F.lit(0)) + padding <= length
