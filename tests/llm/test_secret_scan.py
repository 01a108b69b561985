from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.secret_scan import digest, find_spans, lexed, scan_secrets


def brute(text: str) -> list[tuple[int, int, str]]:
    """Base spans by plain matches that are filtered afterwards."""
    out = []
    name = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(name, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, b, ("assign", "access", "hex")[k]) for a, k, b in sorted(out)]


PIECES = ["token", "API_KEY", "apikey", "passwd", "=", ": ", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "é", "\n", "abc12345", "ſecret", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    got = [(a, b, k) for k, a, b, _ in find_spans(text) if k != "literal"]
    assert got == brute(text)


def found(text: str) -> list[str]:
    return [text[a:b] for _, a, b, _ in lexed(text)]


def test_literals_follow_constants_to_sensitive_names():
    assert found("key = 'Zq8rT2vLx0Pw'\nalias = key\ndbCredential = alias\n") == ["Zq8rT2vLx0Pw"]
    assert found('{"private_key": "Zq8rT2vLx0Pw/91"}') == ["Zq8rT2vLx0Pw/91"]
    assert found("export AUTH_KEY=Zq8rT2vLx0Pw") == ["Zq8rT2vLx0Pw"]


def test_harmless_assignments_are_left_alone():
    assert found("title = 'Zq8rT2vLx0Pw'") == []
    assert found("pwd = 'changeme'\ncredential: ${SECRET_FROM_ENV}\npwd = short") == []
    assert found("the token: a word of prose") == []


def test_literal_inside_a_base_span_is_not_repeated():
    kinds = [k for k, *_ in find_spans('password = "Zq8rT2vLx0Pw"')]
    assert kinds == ["assign"]


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, "é token=abcdefgh12", None, 0), (3, "é token=abcdefgh12", None, 0), (4, "pad " * 50_000 + "AKIA" + "Z" * 12, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, _text int")
    got = sorted(tuple(r) for r in digest(scan_secrets(docs)).collect())
    empty = hashlib.sha256(b"").hexdigest()
    span = "assign:2:18"
    assert got[:4] == [(1, 0, 0, 0, empty, ""), (2, 0, 0, 0, empty, "")] + [(3, 1, 0, 0, hashlib.sha256(span.encode()).hexdigest(), span)] * 2
    assert got[4][2] == 1 and got[4][5] == "access:200000:200016"
    assert digest(scan_secrets(docs.limit(0))).count() == 0
