"""Table schemas and the validation every loader runs before a job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The four sub-labels, in their fixed order, and the headline label.
SUBTYPES = ("shaming", "stereotype", "objectification", "violence")
LABEL = "label"


class SchemaError(ValueError):
    """A table lacks a column or has it with another type."""


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType()}


def struct(fields: str) -> T.StructType:
    """A flat schema from ``name type`` pairs; needs no session, unlike Spark's DDL parser."""
    out = []
    for name, kind in (f.split() for f in fields.split(",")):
        inner = kind.removeprefix("array<").removesuffix(">")
        out.append(T.StructField(name, T.ArrayType(_TYPES[inner]) if kind != inner else _TYPES[kind]))
    return T.StructType(out)


#: A labelled split as stored: tab-separated strings.
SPLIT_RAW = struct("file_name string, label string, shaming string, stereotype string, objectification string, violence string, text string")
#: The typed record a split row becomes.
SAMPLE = struct("image_id string, text string, label int, shaming int, stereotype int, objectification int, violence int")
EMBEDDINGS = struct("image_id string, img_emb array<float>, txt_emb array<float>, label int, subtask array<int>, raw_text string")
PREDICTIONS_LONG = struct("model string, row_id long, actual int, pred int")
PREDICTIONS_MULTI = struct("model string, row_id long, actual array<int>, pred array<int>")
BOXES = struct("image_id string, x1 double, y1 double, x2 double, y2 double")
DETECTIONS = struct("image_id string, x1 double, y1 double, x2 double, y2 double, confidence double")
CATALOGUE = struct("name string, aliases array<string>, subset string, description string, source_url string, license string")
EXPLANATIONS = struct("image_id string, ground_truth int, predicted boolean, explanation string, latency_s double")
SAMPLE_PREDICTION = struct("image_id string, ground_truth int, prediction int, correct boolean, confidence double")
RESULT = T.StructType(
    [
        *struct("model string, filter string, split string, task string").fields,
        *[
            T.StructField(n, T.DoubleType())
            for n in ("accuracy", "exact_match_accuracy", "f1", "precision", "recall", "macro_f1", "micro_f1", "weighted_f1", "score_b", "avg_latency_s", "refusal_rate")
        ],
        T.StructField("sample_predictions", T.ArrayType(SAMPLE_PREDICTION)),
    ]
)
ANNOTATION = struct("visibility_level string, message_type string")


def require(df: DataFrame, schema: T.StructType | list[str]) -> DataFrame:
    """``df`` itself, if it has all named columns (with the given types, if a schema is given)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in schema.fields} if isinstance(schema, T.StructType) else dict.fromkeys(schema)
    missing = [n for n in wanted if n not in have]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    wrong = [f"{n} is {have[n].simpleString()}, not {t.simpleString()}" for n, t in wanted.items() if t is not None and have[n] != t]
    if wrong:
        raise SchemaError("; ".join(wrong))
    return df
