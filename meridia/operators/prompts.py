"""Prompt and target builders as columns, catalogue enrichment of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SUBTYPES

DEFINITIONS = {
    "shaming": "insults someone's body, looks or behaviour",
    "stereotype": "reduces people to a simplified role",
    "objectification": "treats a person as an object",
    "violence": "shows or threatens physical harm",
}


def binary_prompt() -> str:
    return "Look at this item. Is it misogynous? Answer with one word: yes or no."


def category_prompts() -> dict[str, str]:
    return {k: f"Look at this item. Is it true of it that it {d}? Answer with one word: yes or no." for k, d in DEFINITIONS.items()}


def json_prompt(joint: bool = False) -> str:
    """Asks for one boolean per sub-label, and the verdict first if joint."""
    keys = [*(["misogynous"] if joint else []), *SUBTYPES]
    lines = [f"- {k}: {d}." for k, d in DEFINITIONS.items()]
    schema = "{" + ", ".join(f'"{k}": <true|false>' for k in keys) + "}"
    return "\n".join(["Look at this item. Which of these does it show? Several may hold.", *lines, "Answer with exactly this JSON and nothing else:", schema])


def choice_prompt(question: str, options: list[str]) -> str:
    """Options in the order given; a caller that wants another order permutes them itself."""
    return question + "\nReply with exactly one of: " + ", ".join(f'"{o}"' for o in options)


def catalogue_prompts(catalogue: DataFrame, question: str, most: int = 5) -> DataFrame:
    """``subset, prompt``: the first ``most`` symbols of each subset, one a line, before the question."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.trim(F.replace(F.coalesce("description", F.lit("")), F.lit("\n"), F.lit(" "))))
    lists = catalogue.groupBy("subset").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("s"))
    lines = F.transform(F.slice("s", 1, most), lambda x: x["line"])
    return lists.select("subset", F.concat_ws("\n", F.lit("Known symbols:"), F.array_join(lines, "\n"), F.lit(""), F.lit(question)).alias("prompt"))


def with_transcript(prompt: Column, transcript: Column) -> Column:
    """The prompt, preceded by the item's text where there is one."""
    return F.when(F.coalesce(transcript, F.lit("")) != "", F.concat(F.lit('This item contains the text: "'), transcript, F.lit('". '), prompt)).otherwise(prompt)


def json_target(labels: list[str]) -> Column:
    return F.to_json(F.struct(*[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in labels]))


def enriched_labels(labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``label, enriched``: description and label where a symbol's name or alias equals it within the subset; the last entry wins."""
    names = catalogue.select("subset", "ordinal", "description", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    known = names.groupBy("subset", F.lower("n").alias("key")).agg(F.max_by("description", "ordinal").alias("description"))
    out = labels.withColumn("key", F.lower("label")).join(known, ["subset", "key"], "left")
    return out.withColumn("enriched", F.when(F.col("description").isNotNull(), F.concat_ws(" ", "description", "label")).otherwise(F.col("label"))).drop("key", "description")
