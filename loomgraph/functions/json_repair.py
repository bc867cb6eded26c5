"""Tolerant reading of JSON that a model wrote, and folding of text that SQL has no function for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import composed  # noqa: F401  (known by this name too)

# Number words.
NUMBERS = {
    "zero": 0,
    "one": 1,
    "two": 2,
    "three": 3,
    "four": 4,
    "five": 5,
    "six": 6,
    "seven": 7,
    "eight": 8,
    "nine": 9,
    "ten": 10,
    "eleven": 11,
    "twelve": 12,
    "thirteen": 13,
    "fourteen": 14,
    "fifteen": 15,
    "sixteen": 16,
    "seventeen": 17,
    "eighteen": 18,
    "nineteen": 19,
    "twenty": 20,
    "thirty": 30,
    "forty": 40,
    "fifty": 50,
    "sixty": 60,
    "seventy": 70,
    "eighty": 80,
    "ninety": 90,
    "hundred": 100,
}
_WORD = re.compile(r"(:[^\n\"]{0,19}?)\b(" + "|".join(NUMBERS) + r")\b", re.IGNORECASE)


#: What may follow a string: punctuation, the end, or a name or value on the next line.
_AFTER = re.compile(r"\s*(?:[,:}\]]|\Z)|[ \t]*\n\s*\"")


def _trimmed(text: str) -> str:
    """Without fences, links and control characters; from the first brace to the last."""
    text = re.sub(r"\A```(?:json)?\s*|\s*```\Z", "", text.strip())
    text = re.sub(r"\[([^\[\]]+)\]\(https?://[^)]+\)", r"\1", text)
    text = re.sub(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f]", " ", text)
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b else text


def _without_comments(text: str) -> str:
    text = re.sub(r"(?<!:)//[^\n]*", "", text)
    return _WORD.sub(lambda m: m[1] + str(NUMBERS[m[2].lower()]), text)


def _no_trailing_commas(text: str) -> str:
    return re.sub(r",(?=[\s,]*[}\]])", "", text)


def _quotes_escaped(text: str) -> str:
    """Quotes inside a string - not followed by what may follow a string - are escaped."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
            elif _AFTER.match(text, i + 1):
                inside = False
            else:
                out.append("\\")
        out.append(c)
        i += 1
    return "".join(out)


def _names_quoted(text: str) -> str:
    """Bare names are quoted, and commas put between values on neighbouring lines."""
    text = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', text)
    return re.sub(r'(["}\]\d])(\s*\n\s*)(?=")', r"\1,\2", text)


def _one_line(text: str) -> str:
    return re.sub(r"[\r\n]", " ", text)


REPAIRS: tuple[Callable[[str], str], ...] = (_without_comments, _quotes_escaped, _names_quoted, _one_line)


def parse(text: str | None):
    """The value, or None where no repair helps; each repair is tried only if those before did not do."""
    if not text or not text.strip():
        return None
    now = _trimmed(text)
    for repair in (lambda t: t, *REPAIRS):
        now = _no_trailing_commas(repair(now))
        try:
            return json.loads(now)
        except json.JSONDecodeError:
            continue
    return None


def repaired_json(raw: Column) -> Column:
    """Sound JSON as it is, found by the JVM; only the rest goes through the repairs; NULL where they fail."""

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        read = values.map(parse)
        return read.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))

    return F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(repair(raw))
