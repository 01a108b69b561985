"""A labelled list for the literal layer: the literals marked with « » are the findings, and no others."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from tessella.llm.secret_scan import SecretConfig, _scanner, lexed, name_score

V, W = "Zq8rT2vLx0Pw", "mK4nB7cD1eF9"
LABELLED = [
    f'config["db_password"] = "«{V}»"', f'os.environ["API_TOKEN"] = "«{V}»"', f'const pwd: string = "«{V}»"', f"<password>«{V}»</password>",
    f'password = """«{V}»"""', f'A = "«{V}»"\nB = "«{W}»"\npassword = A + B', f'password = "«{V}»" + "«{W}»"', f'P = "«{V}»"\nsecret = f"{{P}}«{W}»"',
    f'password = later\nlater = "«{V}»"', f'API__KEY = "«{V}»"', f'put("db_password", "«{V}»")', f'<add key="ApiToken" value="«{V}»"/>',
    f'<entry name="secret">\n «{V}»\n</entry>', f'<conn password="«{V}»" user="me"/>', f'password = SecretStr("«{V}»")', f"db:\n  password: «{V}»\n  port: 5432",
    f"[db]\npassword = '«{V}»' # note", f"AUTH_KEY=«{V}»", f'"tokens": {{"bearer": "«{V}»"}}', f'var apiKey []byte = "«{V}»"', f'String password = "«{V}»";',
    f'self.secret = "«{V}»"\nx = 1', f'self.k = "«{V}»"\nsend(password=self.k)', f"don't: it's\npassword = '«{V}»'", f'password := "«{V}»"', f"'secret' => '«{V}»',",
    f'password = ("«{V}»"\n)', f'`secret`: `«{V}»`', f'a = "«{V}»"\nb = a\nc = b\ntoken_value = c',
]
CLEAN = [
    "credentials: user_defined_credentials_object", "token = nextToken", "password = get_password()", "password = os.getenv('DB_PASSWORD')", "secret = config.secretName",
    "the key: a word of prose, and the password: none", "password: ${DB_PASSWORD}", f'title = "{V}"', f'x = "{V}" + "{W}"', "password = input('your password, please: ')",
    "password == other_thing1", "<password></password>", "<password>${PASS}</password>", "a = b\nb = a\npassword = a", 'password = "changeme123"', "secret: see http://host/a1b2c3d4e5",
]


def marked(form: str) -> tuple[str, list[str]]:
    return form.replace("«", "").replace("»", ""), re.findall("«(.*?)»", form)


@pytest.mark.parametrize("form", LABELLED)
def test_labelled_literals_are_found(form):
    text, want = marked(form)
    assert [text[a:b] for _, a, b, _ in lexed(text)] == want
    # and a scan, with its test for letter groups, covers each of them by some span
    (out,) = _scanner(SecretConfig())(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])]))
    spans = out.column(1)[0].as_py()
    assert all(any(s["start"] <= text.index(w) and s["end"] >= text.index(w) + len(w) for s in spans) for w in want)


@pytest.mark.parametrize("text", CLEAN)
def test_references_and_prose_are_left_alone(text):
    assert lexed(text) == []


def test_forms_stay_apart_when_put_together():
    rng = random.Random(4)
    lines = [f for f in LABELLED if "A" not in f.split("=")[0].split() and "\n" not in f and "=>" not in f] * 2
    rng.shuffle(lines)
    text, want = marked("\n".join(lines))
    assert [text[a:b] for _, a, b, _ in lexed(text)] == want


def test_no_sensitive_name_escapes_the_letter_groups():
    from tessella.llm.secret_scan import _GROUPS, NAME_WEIGHTS, _PAIRS

    for name in [*NAME_WEIGHTS, *(f"{a}__{b.title()}" for a, b in _PAIRS), *(f"{a.upper()}-{b}" for a, b in _PAIRS)]:
        assert name_score(name) and re.search(_GROUPS, name)


def test_constants_that_grow_are_bounded_and_time_is_linear():
    import time

    text = f'a = "{V}"\n' + "a = a + a\n" * 200 + "password = a\n"
    assert [text[a:b] for _, a, b, _ in lexed(text)] == [V]
    for unit in ('password = "', "secret = a + ", "<key>x", "token = `", "password: [", "'''x ", "a = b; b = a; ", "key = key2\n", "{{password}}"):
        start = time.time()
        lexed(unit * 15_000)
        assert time.time() - start < 8, unit
