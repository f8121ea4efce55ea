"""Explicit schemas of the evaluation tables; nothing is inferred from file contents."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


GROUND_TRUTH = _table(
    question_id=S, area=S, standard=S, question_type=S, question=S, reference_answer=S, generator_model=S, fk_grade=D
)
PANEL_LONG = _table(question_id=S, judge=S, score=I, rationale=S)
RESPONSES = _table(
    question_id=S, area=S, standard=S, question_type=S, run=I, response=S, model_id=S, finish_reason=S, is_error=I,
    response_fk_grade=D, response_reading_ease=D, prompt_tokens=L, completion_tokens=L, reasoning_tokens=L, total_tokens=L,
)
EVAL_LONG = _table(question_id=S, run=I, judge=S, binary=I, rubric=D, is_refusal=I, rationale=S)
EVAL = _table(
    question_id=S, run=I, area=S, standard=S, question_type=S, response=S, binary_score=I, rubric_score=D,
    is_refusal=I, human_review_flag=I, rationale=S,
)
EVAL_FLAGS = _table(model=S, question_id=S, run=I, human_score=S, human_notes=S)
ITEM_FLAGS = _table(question_id=S, human_score=S, human_notes=S)
ITEM_EDITS = _table(question_id=S, question=S, reference_answer=S, keep=S, drop=S)
