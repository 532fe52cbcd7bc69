"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs,
digits, URL schemes and identifier cues.  From every anchor a deterministic
local parser expands to the left and right and validates what it finds.  No
pattern is ever searched for in the whole text.

Kinds ``email``, ``ip``, ``card`` and ``phone`` follow fixed grammars (leftmost,
non-overlapping within a kind, failing candidates dropped).  The method adds
``secret`` (a value of 16 or more characters behind a cue such as ``token =``),
``url`` (a URL with user data before an at-sign) and ``iban``.

A cue inside a value that was scanned already is passed over: its own value would
be an end of that one, and refused or covered with it.  So every parser reads a
character a bounded number of times, and a text costs time in proportion to its
length, however long it is and whatever it repeats.

Rows: a null or empty text has no spans; repeated rows, and rows with equal or null
ids, are each answered; an empty table gives an empty one.  Of spans of one kind
that overlap the leftmost stays; spans of different kinds may overlap.  Extra columns
are not read by :func:`pii_report` and kept by :func:`find_pii`, which replaces one
that is named as its result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarflow.llm.common import small_batches, spread

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "url", "iban")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "bearer")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
SECRET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.")
UPPER_NUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

SPANS = "array<struct<kind:string,start:int,end:int,text:string>>"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    for scheme in SCHEMES:
        found.add_word(scheme, "scheme")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, "cue")
    for form in ("IBAN", "Iban", "iban"):
        found.add_word(form, "iban")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``; it may not begin before ``floor``."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels = len(t), at + 1, 0
    while end < n and t[end] in LABEL:
        end += 1
    if end == at + 1:
        return None
    while end + 1 < n and t[end] == "." and t[end + 1] in LABEL:
        end += 2
        while end < n and t[end] in LABEL:
            end += 1
        labels += 1
    return (start, end) if labels else None


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def dotted_from(t: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of digit groups joined by single dots that begins
    at ``start``, and the end of the chain."""
    n, groups, i = len(t), [], start
    while True:
        j = i
        while j < n and t[j] in DIGITS:
            j += 1
        groups.append((i, j))
        if j + 1 < n and t[j] == "." and t[j + 1] in DIGITS:
            i = j + 1
        else:
            break
    found = []
    for k in range(0, len(groups) - 3, 4):
        four = groups[k : k + 4]
        if all(small_part(t[a:b]) for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, groups[-1][1]


def card_from(t: str, start: int) -> tuple[tuple[int, int] | None, int]:
    """The account number in the chain of digits joined by single spaces or
    hyphens that begins at ``start``, and the end of the chain."""
    n, end = len(t), start + 1
    while end < n:
        if t[end] in DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end - start >= 13:
        digits = t[start:end].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            return (start, end), end
    return None, end


def phone_at(t: str, plus: int) -> tuple[int, int] | None:
    n, end = len(t), plus + 2
    if end > n or t[plus + 1] not in DIGITS:
        return None
    while end < n and t[end] in PHONE:
        end += 1
    while end > plus + 2 and t[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None
    count = sum(c in DIGITS for c in t[plus:end])
    return (plus, end) if 9 <= count <= 15 else None


def secret_after(t: str, end: int) -> tuple[tuple[int, int] | None, int]:
    """The value behind a cue that ends before ``end``: an optional separator,
    an optional quote, then 16 or more characters with a letter and a digit; and
    where the value's characters end, whether it holds or not."""
    n, i = len(t), end
    while i < n and i < end + 3 and t[i] == " ":
        i += 1
    if i < n and t[i] in "=:":
        i += 1
        while i < n and t[i] == " ":
            i += 1
    elif i == end:
        return None, end
    if i < n and t[i] in "\"'":
        i += 1
    start = i
    while i < n and t[i] in SECRET:
        i += 1
    value = t[start:i]
    holds = len(value) >= 16 and any(c in DIGITS for c in value) and any(c.isalpha() for c in value)
    return (start, i) if holds else None, i


def url_from(t: str, start: int, host: int) -> tuple[int, int] | None:
    """A URL whose authority holds user data: scheme://user:word@host."""
    n, i = len(t), host
    while i < n and t[i] not in " \t\n\r/?#\"'<>":
        i += 1
    at = t.rfind("@", host, i)
    return (start, i) if at > host and at + 1 < i else None


def iban_after(t: str, end: int) -> tuple[int, int] | None:
    n, i = len(t), end
    while i < n and i < end + 3 and t[i] in " :":
        i += 1
    start, chars = i, []
    while i < n and len(chars) < 34:
        if t[i] in UPPER_NUM:
            chars.append(t[i])
        elif not (t[i] == " " and i + 1 < n and t[i + 1] in UPPER_NUM and chars):
            break
        i += 1
    code = "".join(chars)
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return None
    value = int("".join(str(int(c, 36)) for c in code[4:] + code[:4]))
    return (start, i) if value % 97 == 1 else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as listed, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    email_end = ip_end = card_end = iban_end = secret_end = value_end = 0
    for at, anchor in automaton().iter(text):
        if anchor == "digit":
            if at >= ip_end:
                spans, ip_end = dotted_from(text, at)
                found["ip"] += spans
            if at >= card_end:
                span, card_end = card_from(text, at)
                if span:
                    found["card"].append(span)
        elif anchor == "at":
            span = email_at(text, at, email_end)
            if span:
                found["email"].append(span)
                email_end = span[1]
        elif anchor == "plus":
            span = phone_at(text, at) if at + 1 < len(text) else None
            if span:
                found["phone"].append(span)
        elif anchor == "cue":
            if at + 2 < value_end:  # at least one more character of that value follows the cue and its separator
                continue
            span, value_end = secret_after(text, at + 1)
            if span and span[0] >= secret_end:
                found["secret"].append(span)
                secret_end = span[1]
        elif anchor == "scheme":
            start = text.rfind("://", 0, at + 1)
            host = at + 1
            while start > 0 and text[start - 1].isalpha() and host - start < 9:
                start -= 1
            span = url_from(text, start, host)
            if span:
                found["url"].append(span)
        else:
            span = iban_after(text, at + 1)
            if span and span[0] >= iban_end:
                found["iban"].append(span)
                iban_end = span[1]
    return [(k, a, b) for k, spans in found.items() for a, b in dict.fromkeys(spans)]


def find_pii(docs: DataFrame, text_col: str = "text", span_col: str = "pii_spans") -> DataFrame:
    """``docs`` with ``span_col``: the spans with kind, code point offsets and text.

    A null or empty text gets an empty list.  A clashing column of that name is
    replaced.
    """

    @F.pandas_udf(SPANS)
    def spans(texts):
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in find(t)])

    return docs.withColumn(span_col, spans(F.col(text_col)))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, their digest, all spans, and how
    many spans the method adds (``n_added``) and there are in all (``n_spans``).

    Only ``doc_id`` and ``text`` are read; a null ``doc_id`` is kept as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = find(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans) - len(base), len(spans)))
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text").mapInArrow(run, schema)
