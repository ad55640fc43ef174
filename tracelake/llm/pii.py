"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, URL schemes, plus signs, digits and the cues of secrets.
From each anchor a small deterministic parser expands to both sides and validates what it finds:

* email: local part to the left of ``@``, a domain with at least one dot to the right;
* ip: four dotted numbers, each at most 255; card: 16 to 19 digits that pass Luhn, single blanks or hyphens between;
* phone: plus sign, then 8 to 15 digits with blanks, dots, hyphens and brackets;
* url: ``http://``, ``https://`` or ``ftp://`` and what follows without white space, quotes and angle brackets;
* secret: ``AKIA`` and 16 upper-case letters or digits; or the value that is assigned to an identifier with a cue such as token, secret, key or password:
  the cue begins a word or a part of one (``api_key``, ``accessToken``), an ``=`` or ``:`` follows, then a value in quotes or a run of other characters than
  white space, commas, semicolons and quotes. A value has at most ``LONGEST`` characters, none of them blank, and either ``LEAST`` of them with a letter and a digit or, after a
  password's cue, four. The span is the value without its quotes.

Per kind the matches are leftmost and do not overlap; a match that fails validation is dropped and its text isn't tried
again. Positions are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; each row gives one row, whatever its doc_id, so repeated rows repeat;
all columns of the input are kept, and one named like the result column is replaced.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ["email", "ip", "card", "phone", "secret", "url"]
DIGITS = frozenset("0123456789")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _UPPER + _UPPER.lower() + "0123456789"
LOCAL = frozenset(_ALNUM + "._%+-")
LABEL = frozenset(_ALNUM + "-")
PHONE = frozenset(" ().0123456789-")
KEY = frozenset(_UPPER + "0123456789")
CARD_GAP = frozenset(" -")
BLANK = frozenset(" \t\n\r\x0b\x0c")
NAME = frozenset(_ALNUM + "_")
LEAST, LONGEST = 8, 512
#: What names a secret. Each is looked for in lower case, in upper case and with a capital.
SECRET_CUES = ("token", "secret", "key", "apikey", "password", "passwd", "pwd")
SPACE, SIGN = frozenset(" \t"), frozenset("=:>")
LETTERS = frozenset(_UPPER + _UPPER.lower())
VALUE_END = BLANK | frozenset("\"',;")
URL_END = BLANK | frozenset("\"'<>")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text, at, least):
    start = at
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end, dots = _run(text, end + 1, LABEL), dots + 1
    return (start, end, True) if dots else None


def _ip(text, at, least):
    if at < least:
        return None
    parts, end = [], at
    for k in range(4):
        if k:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        stop = _run(text, end, DIGITS)
        if stop == end:
            return None
        parts.append(text[end:stop])
        end = stop
    return at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _card(text, at, least):
    if at < least:
        return None
    end, digits, n = at + 1, [text[at]], len(text)
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in CARD_GAP and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return (at, end, 16 <= len(digits) <= 19 and _luhn("".join(digits))) if len(digits) > 1 else None


def _phone(text, at, least):
    if at < least or at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _url(text, at, least):
    if at < least:  # part of the one before; asked first, so that a text is read once
        return None
    end = at
    while end < len(text) and text[end] not in URL_END:
        end += 1
    return (at, end, True) if end > text.index("://", at) + 3 else None


def _key(text, at, least):
    return (at, at + 20, True) if at >= least and _skip(text, at + 4, KEY, 16) == at + 20 else None


def _skip(text: str, at: int, allowed: frozenset, most: int = 64) -> int:
    stop = min(len(text), at + most)
    while at < stop and text[at] in allowed:
        at += 1
    return at


def _secret(text, at, cue, least):
    """The value that the identifier with this cue is given."""
    if at < least or at and text[at - 1] in NAME and text[at - 1] != "_" and not (text[at].isupper() and text[at - 1].islower()):
        return None
    end = at + len(cue)
    if end < len(text) and text[end] == "_":
        end = _skip(text, end, NAME)
    if end < len(text) and text[end] in "\"'":
        end += 1
    end = _skip(text, end, SPACE)
    if end >= len(text) or text[end] not in "=:":
        return None
    start = _skip(text, _skip(text, end, SIGN, 2), SPACE)
    quote = text[start] if start < len(text) and text[start] in "\"'" else ""
    start += len(quote)
    stop, most = start, min(len(text), start + LONGEST + 1)
    while stop < most and text[stop] not in VALUE_END:
        stop += 1
    if stop == start or stop == start + LONGEST + 1:
        return None
    value = text[start:stop]
    if quote and (stop >= len(text) or text[stop] != quote):
        return None
    known = any(c in DIGITS for c in value) and any(c in LETTERS for c in value) and len(value) >= LEAST
    return start, stop, known or len(value) >= 4 and cue.lower() in ("password", "passwd", "pwd")


#: What each anchor starts.
ANCHORS = {"@": ("@",), "+": ("+",), "http://": ("url",), "https://": ("url",), "ftp://": ("url",), "AKIA": ("key",)} | {d: ("digit",) for d in "0123456789"}
ANCHORS |= {form: ("secret",) for cue in SECRET_CUES for form in (cue, cue.upper(), cue.capitalize())}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for cue, (what,) in ANCHORS.items():
        out.add_word(cue, (len(cue), what))
    out.make_automaton()
    return out


def spans_of(text: str, cues: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)

    def take(kind, parser, at):
        if got := parser(text, at, free[kind]):
            free[kind] = got[1]
            if got[2]:
                found[kind].append(got[:2])

    ip_run = -1  # the end of the digit run that the ip parser has tried
    for last, (n, what) in cues.iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= ip_run:
                ip_run = _run(text, at, DIGITS)
                if ip_run < len(text) and text[ip_run] == ".":
                    take("ip", _ip, at)
            if at >= free["card"]:
                take("card", _card, at)
        elif what == "@":
            take("email", _email, at)
        elif what == "+":
            take("phone", _phone, at)
        else:
            if what == "url":
                take("url", _url, at)
            elif what == "key":
                take("secret", _key, at)
            else:
                take("secret", lambda t, a, least, n=n: _secret(t, a, t[a : a + n], least), at)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def find_pii(docs: DataFrame, *, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column ``out``: the spans of each whole text, by kind as listed in KINDS, then by start."""
    @F.pandas_udf(SPAN)
    def scan(texts: pd.Series) -> pd.Series:
        own = automaton()
        return texts.map(lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, own)] if t else [])

    return docs.withColumn(out, scan(F.coalesce(F.col(text), F.lit(""))))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))
