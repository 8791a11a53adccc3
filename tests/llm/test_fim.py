"""Fill-in-the-middle against a brute-force version over code points."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm import ODD_TEXTS, SF01, rows_of

from check import compare, database
from tracebeam.llm import fim, oracle
from tracebeam.llm.queries import queries

SIGNS = fim.check_marks(fim.MARKS)
TEXTS = st.text(st.sampled_from("abZ <>PSM1\n\0\x7fé ß中ﬁ\U0001f600"), max_size=60)


def brute(doc_id, text, unit="token"):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "token" else list(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, None, None, text
    spans = (len(prefix), len(middle), len(prefix.encode()), len(middle.encode()))
    if h4 % 100 < 20:
        return n, "spm", *spans, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", *spans, f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 500)), TEXTS, st.sampled_from(["token", "char"]))
def test_transform_equals_brute_force(doc_id, text, unit):
    got = fim.transform(doc_id, text.encode(), SIGNS, 1, 90, 20, unit)
    assert (*got[:-1], got[-1].decode()) == brute(doc_id, text, unit)
    assert fim.restore(got[-1], got[1], SIGNS).decode() == text


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_indices_convert_every_cut(text, block):
    raw = np.frombuffer(text.encode(), np.uint8)
    index, units = fim.ByteIndex(raw), fim.Units(raw, block)
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert index.bytes(k) == at and index.chars(at) == k
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert units.n == len(tokens)
    assert [units.end(k) for k in range(units.n + 1)] == [len("".join(tokens[:k]).encode()) for k in range(units.n + 1)]


def test_whole_tables_and_sql(spark):
    got = fim.fill_in_middle(spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    want = sorted((r[0], *brute(r[0], r[1])) for r in rows_of("documents", SF01))
    assert sorted(map(tuple, got)) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    outcome, _ = compare(
        spark, database(SF01), queries()["op13_fill_in_middle"], oracle.SQL["op13_fill_in_middle"], SF01
    )
    assert outcome.startswith("ok"), outcome


def test_odd_texts(make_docs):
    rows = ODD_TEXTS + [(30, "has <P> in it"), (31, "a<"), (32, "<<"), (33, "S>a<P")]
    got = fim.restored(fim.fill_in_middle(make_docs(rows))).collect()
    assert sorted((r["doc_id"] or 0, r["restored"]) for r in got) == sorted((d or 0, t or "") for d, t in rows)
    assert sorted((r["doc_id"] or 0, r["form"]) for r in got) == sorted((d or 0, brute(d, t)[1]) for d, t in rows)
    assert fim.digests(make_docs([])).count() == 0
    by_char = fim.fill_in_middle(make_docs(rows), unit="char").collect()
    assert sorted(map(repr, map(tuple, by_char))) == sorted(repr((d, *brute(d, t, "char"))) for d, t in rows)


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("aXb", "b>", "c>")):
        with pytest.raises(ValueError):
            fim.check_marks(marks)
