"""Parsing of free-text model answers, on VARIANT so that ``true`` and ``"true"`` stay apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SUBTYPES
from .binding import once
from .text import REFUSAL_PHRASES, text_or_empty

_INNER_OBJECT = r"(?s)(\{[^{}]*\})"
_OUTER_OBJECT = r"(?s)(\{.*\})"


def _word(word: str) -> str:
    return r"\b" + re.escape(word.lower()) + r"\b"


def _object(answer: Column, pattern: str = _INNER_OBJECT) -> Column:
    """The answer's JSON object as a VARIANT; null without one or for another kind of value."""
    value = F.try_parse_json(F.nullif(F.regexp_extract(text_or_empty(answer), pattern, 1), F.lit("")))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _flag(value: Column, key: str) -> Column:
    """1 or 0 for a boolean or a number (from 0.5 up), null for anything else or nothing."""
    item = F.try_variant_get(value, f"$.{key}", "variant")
    kind = F.schema_of_variant(item)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, f"$.{key}", "double"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, f"$.{key}", "boolean").cast("int")).when(number.isNotNull(), (number >= 0.5).cast("int"))


def _has_key(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant").isNotNull()


def extract_label(answer: Column, labels: list[str]) -> Column:
    """The label an answer equals (quotes stripped), else the first it holds as a word, else null."""
    plain = F.lower(F.regexp_replace(F.trim(text_or_empty(answer)), "^[\"']+|[\"'.]+$", ""))
    found = [F.when(plain == x.lower(), F.lit(x)) for x in labels]
    found += [F.when(plain.rlike(_word(x)), F.lit(x)) for x in labels]
    return F.coalesce(*found)


def extract_subtypes(answer: Column, labels: tuple[str, ...] = SUBTYPES) -> Column:
    """Array of 0/1 per label: JSON with a boolean or number under some label, else ``none``, else label words."""
    flags = once(_object(answer), lambda value: F.array(*[_flag(value, x) for x in labels]))
    words = once(F.lower(text_or_empty(answer)), lambda low: F.array(*[(~low.rlike(r"\bnone\b") & low.rlike(_word(x))).cast("int") for x in labels]))
    return once(flags, lambda f: F.when(F.exists(f, lambda x: x.isNotNull()), F.transform(f, lambda x: F.coalesce(x, F.lit(0)))).otherwise(words))


def extract_joint(answer: Column, labels: tuple[str, ...] = ("misogynous", *SUBTYPES)) -> Column:
    """As ``extract_subtypes`` with JSON only: anything else is all zeros."""
    return once(_object(answer), lambda value: F.array(*[F.coalesce(_flag(value, x), F.lit(0)) for x in labels]))


def parse_status(answer: Column, labels: tuple[str, ...] = SUBTYPES) -> Column:
    """``empty, json, none, labels`` or ``unparseable``; any expected key makes an object ``json``."""
    value = _object(answer)
    any_key = F.lit(False)
    any_word = F.lit(False)
    low = F.lower(text_or_empty(answer))
    for x in labels:
        any_key = any_key | F.coalesce(_has_key(value, x), F.lit(False))
        any_word = any_word | low.rlike(_word(x))
    return (
        F.when(F.trim(text_or_empty(answer)) == "", "empty")
        .when(any_key, "json")
        .when(low.rlike(r"\bnone\b"), "none")
        .when(any_word, "labels")
        .otherwise("unparseable")
    )


def is_refusal(answer: Column) -> Column:
    low = F.lower(text_or_empty(answer))
    return F.exists(F.lit(list(REFUSAL_PHRASES)), lambda p: F.contains(low, p))


def is_parse_failure(answer: Column, labels: tuple[str, ...] = SUBTYPES) -> Column:
    """Empty, unparseable or a refusal; a confident all-false object is none of these."""
    return parse_status(answer, labels).isin("empty", "unparseable") | is_refusal(answer)


def parse_prediction(answer: Column, classes: list[str]) -> Column:
    """The longest class the answer holds as a word, else as a substring, else null."""
    low = F.lower(text_or_empty(answer))
    ordered = sorted(classes, key=lambda c: -len(c))
    return F.coalesce(*[F.when(low.rlike(_word(c)), F.lit(c)) for c in ordered], *[F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in ordered])


def parse_verdict(answer: Column, key: str = "misogynous") -> Column:
    """``struct<verdict boolean, explanation string>`` of an explainer's JSON answer.

    Here the string "true" counts; without a parseable object the verdict is
    looked for in the text and the explanation falls back to all of it.
    """
    value = _object(answer, _OUTER_OBJECT)
    item = F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    said = F.when(item == "BOOLEAN", F.try_variant_get(value, f"$.{key}", "boolean")).when(item == "STRING", F.lower(F.try_variant_get(value, f"$.{key}", "string")) == "true")
    low = F.lower(text_or_empty(answer))
    loose = F.when(F.contains(low, F.lit(f'"{key}": true')) | F.contains(low, F.lit(f'"{key}":true')), True)
    loose = loose.when(F.contains(low, F.lit(f'"{key}": false')) | F.contains(low, F.lit(f'"{key}":false')), False)
    quoted = F.nullif(F.regexp_extract(text_or_empty(answer), r'"explanation"\s*:\s*"([^"]+)"', 1), F.lit(""))
    explained = F.nullif(F.try_variant_get(value, "$.explanation", "string"), F.lit(""))
    return F.struct(
        F.when(value.isNotNull(), said).otherwise(loose).alias("verdict"),
        F.when(value.isNotNull(), explained).otherwise(F.coalesce(quoted, answer)).alias("explanation"),
    )
