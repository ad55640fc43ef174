"""Scalar functions on texts, locators and roles. All are column expressions but nfc."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Unicode normal form C; Spark has no function for it. Only texts with letters outside ASCII are sent to Python."""
    plain = F.octet_length(text) == F.length(text)

    @F.pandas_udf("string")
    def norm(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.when(plain, text).otherwise(norm(F.when(~plain, text)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def language(text: Column) -> Column:
    """ko, en, mixed or unknown by the share of Hangul among letters (FN-2)."""
    ko, en = F.length(F.regexp_replace(text, "[^가-힣]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    share = ko / (ko + en)
    return F.when((ko + en) == 0, "unknown").when(share >= 0.7, "ko").when(share <= 0.3, "en").otherwise("mixed")


def normalize(text: Column) -> Column:
    """Normal form C, white space of any kind as single blanks, none at the ends (FN-1)."""
    return collapse(nfc(text))


def reference(text: Column, kind: str) -> Column:
    """The first reference of a kind, such as ticket-217, in lower case; a gate may also be written H1 gate (FN-3)."""
    pattern = rf"\b{kind}-\w+\b"
    if kind == "gate":
        pattern = rf"\b[Hh]\d+\s*gate\b|{pattern}"
    return F.lower(F.nullif(F.regexp_extract(text, f"(?iU){pattern}", 0), F.lit("")))


#: Pattern of a reference and its concepts, first match wins.
CONCEPTS = [
    (r"^ticket-\d+$", ["TicketEvent"]),
    (r"^run-\w+$", ["RunContext"]),
    (r"^wf-\w+$", ["WorkflowEntity"]),
    (r"^gate-\w+$", ["RunContext", "HITLGateContext"]),
    (r"^manifest-\w+$", ["RunManifest"]),
]


def concepts(ref: Column) -> Column:
    """The concepts of the first pattern that a reference matches, none if it matches none (FN-5)."""
    out = F.array().cast("array<string>")
    for pattern, names in reversed(CONCEPTS):
        out = F.when(ref.rlike(f"(?iU){pattern}"), F.array(*map(F.lit, names))).otherwise(out)
    return out


def locator(value: Column) -> Column:
    """Slashes one way and single, no leading ./ or ../ (FN-6)."""
    v = F.regexp_replace(F.regexp_replace(F.trim(value), r"\\", "/"), "/+", "/")
    return F.regexp_replace(v, r"^(\.{1,2}/)+", "")


def short_id(value: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(value), 1, n)


def slug(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_.-]", "_")


def tokens(value: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9_.-]{3,}"), F.lit(0)), F.lower))


#: The words for a priority, in the order in which they are looked for.
PRIORITIES = (("높여", "high"), ("높게", "high"), ("올려", "high"), ("high", "high"), ("낮춰", "low"), ("낮게", "low"), ("내려", "low"), ("low", "low"), ("보통", "normal"), ("normal", "normal"), ("긴급", "urgent"), ("urgent", "urgent"))


def keyword_value(text: Column, pairs: tuple[tuple[str, str], ...] = PRIORITIES) -> Column:
    """The value of the first word, in declared order, that the text contains in lower case; null if none (FN-4)."""
    return F.coalesce(*[F.when(F.lower(text).contains(word), value) for word, value in pairs])


def safe(value: Column) -> Column:
    """All but letters, digits, dot, dash and underscore become an underscore (FN-11)."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}._-]", "_")
