"""Row types of questions, validations and results."""

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Names of fields as stored files have them.
POSITION = _struct(start_pos=_L, end_pos=_L)
QUESTION = _struct(question=_S, question_type=_S, choice=T.MapType(_S, _S), answer=T.ArrayType(_S), position=POSITION)
VALIDATION = _struct(is_valid=_B, model_answer=T.ArrayType(_S), answer_matches=_B, evidence=_S, evidence_found=_B, evidence_similarity=_D, is_answerable=_B, confidence=_S, failure_reasons=T.ArrayType(_S), reasoning=_S)
VALIDATED_QUESTION = T.StructType([*QUESTION.fields, T.StructField("validation", VALIDATION)])
RESULT = _struct(question=_S, question_type=_S, choice=T.MapType(_S, _S), correct_answer=T.ArrayType(_S), model_answer=T.ArrayType(_S), raw_answer=_S, parsing_status=_S, position=POSITION, score=_D, metrics=T.MapType(_S, _D))
DEPTH_RESULT = T.StructType([*RESULT.fields, *_struct(depth=_D, depth_bin=_S, test_context_length=_L, error_message=_S, test_mode=_S).fields])

# Values that stored files hold.
QUESTION_TYPES = ("single_choice", "multiple_choice", "negative_question")
CONFIDENCE = ("low", "medium", "high")
FAILED = ("error", "timeout", "context_build_error", "parsing_error")
DEPTH_LABELS = ("0%", "25%", "50%", "75%", "100%")
