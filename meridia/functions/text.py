"""Text functions, Column to Column.

Null is '' wherever a text is expected.  Regular expressions name ASCII classes
where the semantics are ASCII and use ``(?U)`` where they are Unicode's.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English stop words, in the customary order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself "
    "she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren "
    "aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

#: Phrases that mark a refusal.
REFUSAL_PHRASES = ("i cannot", "i'm unable", "i am unable", "i'm not able", "inappropriate", "harmful", "i can't", "as an ai")

_URL = r"\S*https?:\S*"
_NOT_WORD = r"[^A-Za-z0-9_-]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_of(c: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w != "")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), _URL, "")


def clean_text(c: Column) -> Column:
    """Lower case, without URLs, non-letters, stop words and single letters.

    Punctuation goes before the stop words are looked up, so ``don't`` stays as ``dont``.
    """
    return F.array_join(clean_words(c), " ")


def clean_words(c: Column) -> Column:
    """The words of ``clean_text``; a list this long becomes a hash set in the plan."""
    letters = F.regexp_replace(strip_urls(F.lower(c)), r"[^a-zA-Z\s]", "")
    return F.filter(words_of(letters), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t))


def normalize_text(c: Column) -> Column:
    """NFKC, lower case, single blanks, trimmed; only NFKC leaves the JVM, and not for ASCII."""
    t = text_or_empty(c)
    composed = F.when(t.rlike(r"^\p{ASCII}*$"), t).otherwise(_nfkc(t))
    return F.regexp_replace(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "), r"^ | $", "")


def combine_texts(provided: Column, ocr: Column) -> Column:
    """The provided text and those OCR words it lacks (case-insensitively), in order, duplicates kept."""
    have = words_of(F.lower(provided))
    extra = F.filter(words_of(ocr), lambda w: ~F.array_contains(have, F.lower(w)))
    return F.trim(F.concat_ws(" ", text_or_empty(provided), F.array_join(extra, " ")))


def confident_text(words: Column, least: float = 0.3) -> Column:
    """Words of an ``array<struct<text, confidence>>`` that were read with enough confidence, in order."""
    return F.array_join(F.transform(F.filter(words, lambda w: w["confidence"] >= least), lambda w: w["text"]), " ")


def text_or_placeholder(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("empty text"))


def yes_no(c: Column) -> Column:
    """1, 0 or null."""
    word = F.lower(F.trim(c))
    return F.when(word == "yes", 1).when(word == "no", 0)


def label_word(c: Column) -> Column:
    return F.when(c == 1, "yes").otherwise("no")


def parse_vector(c: Column) -> Column:
    """``"0, 1,1.0"`` to ``[0, 1, 1]``; quotes and blank items are dropped."""
    items = F.split(F.regexp_replace(text_or_empty(c), "[\"']", ""), ",")
    return F.transform(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("double").cast("int"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, _NOT_WORD, "_")


def unicode_tokens(c: Column) -> Column:
    r"""Lower-cased ``\w+`` runs, Unicode's ``\w``."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"(?U)(\w+)"), F.lit(1))


#: Words a title's token set leaves out.
TITLE_STOP_WORDS = ("a", "an", "and", "the", "of", "in", "on", "for", "to", "with", "by", "from", "at", "is", "as")


def title_tokens(c: Column) -> Column:
    """Distinct title words of two letters or digits and more, without stop words."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text_or_empty(c), r"[{}]", "")), r"[^a-z0-9\s-]", " ")
    parts = F.transform(F.split(plain, r"[\s_-]"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*TITLE_STOP_WORDS)))


def first_year(c: Column) -> Column:
    """First year of 1900 to 2099 standing alone, else null."""
    return F.nullif(F.regexp_extract(text_or_empty(c), r"\b(20\d{2}|19\d{2})\b", 1), F.lit(""))


def percent(c: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", c * 100), F.lit("N/A"))


def four_places(c: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", c), F.lit("N/A"))


def display_name(c: Column) -> Column:
    """A model's name as tables print it."""
    short = F.replace(F.replace(c, F.lit("Tabular: "), F.lit("")), F.lit("Classifier"), F.lit(""))
    short = F.regexp_replace(short, "_-_|_", " ")
    return F.trim(F.replace(short, F.lit("Support Vector Machine"), F.lit("SVM")))


#: Accepted task names.
TASK_NAMES = {
    "binary": "binary", "singleclass": "binary", "task_a": "binary", "a": "binary",
    "multiclass": "multilabel", "multilabel": "multilabel", "task_b": "multilabel", "b": "multilabel",
    "joint": "joint", "per_category": "per_category",
}


def task_name(name: str) -> str:
    key = name.strip().lower()
    if key not in TASK_NAMES:
        raise ValueError(f"unknown task {name!r}")
    return TASK_NAMES[key]


def text_source(explicit: str | None = None, use_ocr: bool = False) -> str:
    """An explicit source wins, else OCR if asked for, else the provided text."""
    source = explicit or ("ocr" if use_ocr else "provided")
    if source not in ("provided", "ocr", "combined"):
        raise ValueError(f"unknown text source {source!r}")
    return source


def source_suffix(source: str, engine: str) -> str:
    return "" if text_source(source) == "provided" else f"_{source}_{engine}"
