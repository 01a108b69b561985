from __future__ import annotations

import time

import pyarrow as pa
import pytest

from tessella.llm.secret_scan import SecretConfig, _scanner, lexed

V = "Zq8rT2vLx0Pw"
FORMS = [
    'password: str = "V"', 'const apiKey: string = "V";', 'var token string = "V"', 'db_password: Optional[str] = "V"', "secret: str | None = 'V'",
    'password = b"V"', "password = r'V'", 'password = f"V"', 'var password = @"V";', 'password = rb"V"',
    'password = """V"""', "password = '''V'''", 'password: str = """V"""', 'os.environ["DB_PASSWORD"] = "V"', "config['secret'] = 'V'",
    'const password = "V"', 'var secret = "V"', 'def f(a: int, password="V"):', 'def f(a: int = 3, password: str = "V"):',
]


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_assignments(form):
    text = form.replace("V", V)
    assert [text[a:b] for _, a, b, _ in lexed(text)] == [V]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    (out,) = _scanner(SecretConfig())(iter([batch]))
    assert any(s["start"] <= text.index(V) and s["end"] >= text.index(V) + len(V) for s in out.column(1)[0].as_py()), form


def test_types_alone_and_prose_are_left_alone():
    for text in ("password: str", "the token: a word of prose = x", "token == other", "password: str = None\ntitle = 'Zq8rT2vLx0Pw'"):
        assert lexed(text) == []


def test_time_stays_linear():
    for unit in ("password: a ", "token b ", 'password = """x ', "secret: [", "a "):
        start = time.time()
        lexed(unit * 20_000)
        assert time.time() - start < 5
