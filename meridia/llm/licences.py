"""License scans: Aho-Corasick for tags and notices, shunting-yard for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_rows, clipped

#: Phrases every scan reports, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and identifiers the method adds, as words, with label and strength of evidence.
NOTICES = {
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license": ("apache", 0.8),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "isc license": ("isc", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.7),
    "creative commons": ("cc", 0.7),
    "public domain": ("public-domain", 0.4),
    "unlicense": ("unlicense", 0.6),
    "licensed under": ("notice", 0.4),
    "spdx license identifier": ("spdx", 0.95),
}
BASE_STRENGTH = 0.8
TAG = "spdx license identifier"

#: How freely a licence lets a text be used, by identifier prefix; longest prefix wins.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "0bsd": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9,
    "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1,
}

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Only letters a-z, digits and non-ASCII bytes stay; A-Z fall to lower case, all else to a blank.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_AFTER_TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t:=]*([^\r\n]*)", re.IGNORECASE)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the licence expression's longest well-formed start, in postfix order.

    ``with`` binds before ``and`` before ``or``; operators may be in any case.
    Unbalanced parentheses or a missing operand give [].
    """
    best: list[str] = []
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        op = token.lower()
        if operand_next:
            if op in _RANK or token == ")":
                break
            if token == "(":
                stack.append(token)
                continue
            out.append(op)
            operand_next = False
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif op in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand_next = True
        else:
            break
        if not operand_next and "(" not in stack:
            best = out + stack[::-1]
    return best


def freedom(identifier: str) -> float:
    """Between 0 and 1; 0 for an unknown licence."""
    found = [p for p in FREEDOM if identifier == p or identifier.startswith((p + "-", p + "+"))]
    return FREEDOM[max(found, key=len)] if found else 0.0


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Freedom of an expression and its licences.

    ``or`` lets the user choose the freer side, ``and`` binds to the stricter,
    and an exception after ``with`` relaxes its licence half way to free.
    """
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((freedom(token), {token}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((1 + a) / 2 if a else 0.0, left))
        else:
            stack.append(((max if token == "or" else min)(a, b), left | right))
    return stack[0] if stack else (0.0, set())


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, expressions``."""
    raw = text or ""
    words = b" %b " % b" ".join(raw.encode().translate(_WORDS).split())
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    padded = words.decode()
    starts, n_base, base, labels, doubt, expressions, free = [], 0, set(), set(), {}, [], []
    for end, phrase in machine.iter(padded):
        if phrase in BASE:
            n_base += 1
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            doubt[BASE[phrase]] = 1 - BASE_STRENGTH
        if phrase in NOTICES:
            label, strength = NOTICES[phrase]
            labels.add(label)
            doubt[label] = min(1 - strength, doubt.get(label, 1.0))
    if "spdx" in labels:
        for tail in _AFTER_TAG.findall(raw):
            if postfix := to_postfix(tail):
                value, licences = evaluate(postfix)
                free.append(value)
                labels |= licences
                expressions.append(" ".join(postfix))
    certain = 1.0
    for d in doubt.values():
        certain *= d
    at = [padded.count(" ", 0, min(starts)), padded.count(" ", 0, max(starts))] if starts else [None, None]
    return (n_words, n_base, *at, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - certain if doubt else 0.0, min(free, default=None), expressions)


_SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("freedom", T.DoubleType()),
        T.StructField("expressions", T.ArrayType(T.StringType())),
    ]
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.list_(pa.string())]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text; one row per input row, no shuffle.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters.  ``n_base`` counts all places of the base phrases,
    ``first_word`` and ``last_word`` are their least and greatest start word
    (null without one), ``labels`` also hold the notices' and the expressions'
    licences, ``score`` is the evidence that the text states a licence,
    ``freedom`` the least freedom of its tagged expressions (null without one)
    and ``expressions`` those in postfix order.  A null text counts as empty:
    no words, no labels, score 0.
    """
    rows = clipped(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([rows.schema["doc_id"], *_SCHEMA.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            found = [scan(text, machine) for (text,) in arrow_rows(batch, "text")]
            if found:
                arrays = [pa.array(c, k) for c, k in zip(zip(*found), _ARROW)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return rows.mapInArrow(work, schema)
