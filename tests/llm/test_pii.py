"""Anchor expansion against regular expressions over whole texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cedarflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("0123456789 +-.()@aé%_/"), max_size=60))
def test_same_as_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_long_digit_run_and_known_cases():
    assert pii.find("9" * 6000) == []
    text = "call +1 (017) 555-7713 or a.b@c.d.example, 4539 1488 0343 6467, 10.0.0.255 and 1.2.3.256"
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute(text)
    assert [k for k, *_ in brute(text)] == ["email", "ip", "card", "phone"]
    kinds = {k for k, *_ in pii.find('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" see https://me:pw1@host.example/x IBAN DE89 3704 0044 0532 0130 00')}
    assert kinds >= {"secret", "url", "iban"}


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a@b.c " * 30000, "x"), (3, "a@b.c", "x"), (None, "+12 3456789", "x")], "doc_id long, text string, spans string")
    rows = {(r["doc_id"], r["n_email"]): r for r in pii.pii_report(docs).collect()}
    assert len(rows) == 5 and rows[(3, 30000)] and rows[(None, 0)]["n_phone"] == 1 and rows[(1, 0)]["spans"] == ""
    assert pii.pii_report(docs.limit(0)).count() == 0
    found = pii.find_pii(docs).filter("doc_id is null").first()
    assert found["pii_spans"][0]["text"] == "+12 3456789" and found["spans"] == "x"
