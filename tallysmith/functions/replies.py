"""Reading JSON verdicts out of free-form model replies (VARIANT based, never raises)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column, bind


def _as_object(text: Column) -> Column:
    return bind(
        F.try_parse_json(text), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fence(reply: Column | str) -> Column:
    """Remove a surrounding code fence and blanks."""

    def unfenced(text: Column) -> Column:
        inner = F.regexp_replace(text, r"(?s)^```(?:json)?|```(?:(?!```).)*$", "")
        return F.when(text.startswith("```"), _strip(inner)).otherwise(text)

    return bind(_strip(as_column(reply)), unfenced)


def parse_reply(reply: Column | str) -> Column:
    """The reply as a VARIANT object: the whole text, else its outermost braces, else NULL."""

    def parsed(clean: Column) -> Column:
        first, last = F.instr(clean, "{"), F.length(clean) - F.instr(F.reverse(clean), "}") + 1
        braces = F.when((first > 0) & (last > first), F.substring(clean, first, last - first + 1))
        return F.coalesce(_as_object(clean), _as_object(braces))

    return bind(strip_fence(reply), parsed)


def _field(obj: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", kind)


def _is_text(obj: Column, name: str) -> Column:
    part = F.try_variant_get(obj, f"$.{name}", "variant")
    return F.coalesce(F.schema_of_variant(part) == "STRING", F.lit(False))


def binary_verdict(obj: Column, name: str) -> Column:
    """1 for 1, "1", 1.0 and true; everything else (0, junk, missing) is 0."""
    text, number = _field(obj, name, "string"), _field(obj, name, "double")
    yes = F.when(_is_text(obj, name), text == "1").otherwise((number == 1.0) | (text == "true"))
    return F.coalesce(yes, F.lit(False)).cast("int")


def rubric_verdict(obj: Column, name: str, use_rubric: Column) -> Column:
    """0, 0.5 or 1 (number or text) where a rubric applies, junk is 0; NULL where none applies."""
    text, number = _field(obj, name, "string"), _field(obj, name, "double")
    from_text = F.when(text.isin("0", "0.5", "1"), text.try_cast("double"))
    from_number = F.when(number.isin(0.0, 0.5, 1.0), number).when(text == "true", F.lit(1.0))
    value = F.when(_is_text(obj, name), from_text).otherwise(from_number)
    return F.when(use_rubric, F.coalesce(value, F.lit(0.0)))


def rationale(obj: Column, name: str = "rationale") -> Column:
    """The reason given, whole."""
    return F.coalesce(_field(obj, name, "string"), F.lit(""))


def default_true(obj: Column, name: str) -> Column:
    """A yes/no gate that accepts when the answer is missing or unreadable."""
    return F.coalesce(_field(obj, name, "boolean"), F.lit(True))


def question_items(obj: Column) -> Column:
    """Array of (question, answer), trimmed; entries that are no object or miss a part are left out."""
    raw = F.try_variant_get(obj, "$.items", "array<variant>")
    trimmed = F.transform(
        raw,
        lambda i: F.struct(
            F.trim(_field(i, "question", "string")).alias("question"),
            F.trim(_field(i, "answer", "string")).alias("answer"),
        ),
    )
    return F.filter(trimmed, lambda i: (F.length(i["question"]) > 0) & (F.length(i["answer"]) > 0))


def total_tokens(total: Column | str, prompt: Column | str, completion: Column | str) -> Column:
    """Reported total, or prompt + completion when the provider left it out."""
    zero = F.lit(0).cast("bigint")
    fallback = F.coalesce(as_column(prompt), zero) + F.coalesce(as_column(completion), zero)
    return F.coalesce(F.nullif(as_column(total), zero), fallback)


def effective_temperature(omit: Column | str, fixed: Column | str, requested: Column | str) -> Column:
    """A model that takes no temperature gets none; a fixed one wins over the request."""
    omitted = F.coalesce(as_column(omit), F.lit(False))
    return F.when(~omitted, F.coalesce(as_column(fixed), as_column(requested)))
