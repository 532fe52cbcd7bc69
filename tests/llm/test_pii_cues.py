"""Cues one after another, and the report's digest by regular expressions."""

import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from cedarflow.llm import pii
from tests.llm.test_pii import brute

BITS = ["token", "secret", "=", ": ", " ", "\"", "a1", "b", "9", "password=", "bearer ", "x" * 15, "0123456789abcdef", "\n", "-", ".", "é", "API_KEY", "=="]


def every_cue(text):
    """Each cue's value scanned anew, whatever was scanned before."""
    out, end = [], 0
    for at, anchor in pii.automaton().iter(text):
        if anchor == "cue":
            span, _ = pii.secret_after(text, at + 1)
            if span and span[0] >= end:
                out.append(("secret", *span))
                end = span[1]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
def test_cues_as_if_each_were_scanned(text):
    assert [s for s in pii.find(text) if s[0] == "secret"] == every_cue(text)


def test_time_in_proportion():
    for unit in ("token=", "token=a1", "token ", "bearer ", "secret:", "a@", "+1", "http://", "1.", "1 ", "IBAN "):
        text = unit * (1_200_000 // len(unit))
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 8, unit
    began = time.process_time()
    assert pii.find("token=" * 200_000) == []
    assert time.process_time() - began < 1


def test_report_against_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumnRenamed("doc_id", "doc_id")
    odd = spark.createDataFrame([(None, "a@b.c and 1.2.3.4"), (-1, None), (-1, ""), (-2, "+12 345 67890"), (-2, "+12 345 67890")], docs.schema)
    both = docs.unionByName(odd)
    want = []
    for r in both.collect():
        spans = sorted(brute(r["text"] or ""), key=lambda s: (pii.BASE_KINDS.index(s[0]), s[1]))
        want.append((str(r["doc_id"]), *[sum(s[0] == k for s in spans) for k in pii.BASE_KINDS], hashlib.sha256(pii.digest(spans).encode()).hexdigest()))
    rows = pii.pii_report(both.selectExpr("*", "'x' AS n_email", "1 AS spans")).collect()
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == sorted(want)
    for r in rows:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert r["n_spans"] == len(kinds) and r["n_added"] == sum(k in pii.ADDED_KINDS for k in kinds)
