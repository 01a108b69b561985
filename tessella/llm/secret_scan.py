"""Secret scans: fixed patterns, and an assignment-aware lexer for source and configuration text.

Two layers over each whole text:

* base kinds ``assign``, ``access`` and ``hex``: leftmost non-overlapping matches of fixed patterns;
* ``literal``: the text is lexed into strings, words, operators and line ends, and these are parsed into
  name-literal pairs. Targets are names before ``=``, ``:=``, ``:`` and ``=>``, with or without a type
  (``name: Type =``, ``var name Type =``), quoted keys (JSON, YAML, dictionaries), subscripts
  (``x["name"] =``), elements and attributes of XML, and a name as an argument before a literal
  (``put("name", "...")``). Values are strings (also prefixed and triple ones), sums of them, f-strings
  and other templates, a single string in a call, and bare values of configuration files. Constants are
  propagated in two passes: a word that is no literal stands for what was last assigned to that name, or
  for the first later assignment if there is none before. A literal is scored by how sensitive its target
  name is and by how random its whole value looks; from ``threshold`` on each of its parts is a finding.
  Those that overlap a base span are left out, as that span stands already.

A bare word that looks like a name (``user_name``, ``userName``) and has no assignment is a reference, not
a literal. Comments are lexed as code, as what is commented out leaks as well. Texts go unlexed only if
they hold none of the letter groups that every sensitive name has, so that no finding is lost. Patterns
use possessive quantifiers, so time is linear in the text; constants are put together up to
``most_parts`` parts. Rows are independent: no shuffle, one Arrow batch in memory at a time.

Defined results: null text acts as empty and has no spans; offsets are code points, end exclusive; texts
of any length are scanned whole; repeated rows get equal spans; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import lean

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

# Words in a target name, and how sensitive each makes it.
NAME_WEIGHTS = {
    "password": 0.6, "passwd": 0.6, "pwd": 0.55, "passphrase": 0.6, "pass": 0.4, "secret": 0.6,
    "token": 0.5, "apikey": 0.6, "credential": 0.55, "credentials": 0.55, "privatekey": 0.6,
    "accesskey": 0.6, "secretkey": 0.6, "authkey": 0.55, "bearer": 0.45, "signingkey": 0.55, "encryptionkey": 0.55,
}
#: Pairs of words that make one of the names above.
_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("auth", "key"), ("signing", "key"), ("encryption", "key")}
# Literals that stand for a secret without being one.
PLACEHOLDERS = ("changeme", "example", "placeholder", "your_", "your-", "dummy", "xxxx", "todo", "none", "null", "redacted")

#: Letter groups of which every name with a weight holds one.
_GROUPS = "(?i)pass|pwd|secret|token|credential|bearer|key"
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
#: What marks a string that is more than its characters, before the quote.
_PREFIX = r"(?:(?<![A-Za-z0-9_])(?:[rRbBuUfFlL]{1,2}(?=[\"'])|\$@|@\$|\$|@))?"
_TOKEN = re.compile(
    rf"""(?P<s>{_PREFIX}(?:\"{{3}}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{{3}}|'{{3}}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{{3}}"""
    rf"""|"(?:[^"\\\n]|\\.)*+"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*+'|(?<=[rRbBuUfFlL])'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`))"""
    r"""|(?P<w>[A-Za-z_$][\w.\-]*+)|(?P<o>:=|=>|==|!=|<=|>=|::|:(?=//)|[=:+,;(){}\[\]<>])|(?P<n>\n)|(?P<x>[^\s"'`A-Za-z_$=:+,;(){}\[\]<>]++|.)""",
    re.A,
)
_BLANK = re.compile(r"[ \t]*+")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]++""")
_TYPE = r"[A-Za-z_*][\w.?*]*+(?:\[[^\[\]\n=]*+(?:\[[^\[\]\n=]*+\][^\[\]\n=]*+)*+\]|<[^<>\n=]*+>)*+"
#: A type and the equals sign after it.
_TYPED = re.compile(rf"[ \t]*+{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+[ \t]*+=(?![=>])", re.A)
_IDENT = re.compile(r"[A-Za-z_$][\w.]*+", re.A)
#: Words that read like a name: in lower case, capitals or camel case, parts joined by dots and the like.
_PLAIN = r"(?:[a-z]++(?:[A-Z][a-z]++)*+|(?:[A-Z][a-z]++)++|[A-Z]++)\d?"
_NAME_LIKE = re.compile(rf"\$?{_PLAIN}(?:[._-]{_PLAIN})*", re.A)
_HOLE = re.compile(r"\$?\{([A-Za-z_$][\w.]*+)\}", re.A)
_ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][\w.:-]*+)(?P<with>(?:\s[^<>]*+)?)>(?P<body>[^<>]++)</(?P=tag)\s*+>", re.A)
_CALLED = re.compile(r"""\b(?:key|name|id)\s*+=\s*+["']([^"'<>]*+)["']""", re.A)
_NAMED_VALUE = re.compile(r"""\b(?:key|name)\s*+=\s*+"([^"<>]*+)"\s++value\s*+=\s*+"([^"<>]*+)\"""", re.A)

SCHEMA = "spans array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class SecretConfig:
    assign_chars: int = 8
    access_chars: int = 16
    literal_chars: int = 8
    threshold: float = 0.7
    #: parts of a value that sums and constants put together; beyond it, the first count
    most_parts: int = 64


def name_score(name: str) -> float:
    """Sensitivity of a target name by its words: ``dbPassword``, ``api-key`` and ``API_KEY`` alike."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False) if (a, b) in _PAIRS}
    return max((NAME_WEIGHTS.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


def literal_score(value: str, config: SecretConfig = SecretConfig()) -> float:
    """0 for what is too short or a placeholder, else up to 0.4 by entropy and character classes."""
    low = value.lower()
    if len(value) < config.literal_chars or any(p in low for p in PLACEHOLDERS) or value[0] in "$%{<":
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit))
    classes += any(not c.isalnum() and not c.isspace() for c in value)
    return 0.0 if entropy < 2 or " " in value and classes < 3 else min(0.4, 0.06 * entropy + 0.05 * classes)


def _inside(text: str, a: int, b: int) -> tuple[int, int, bool]:
    """The content of the string at ``a`` to ``b``, and whether it may have holes."""
    q = a
    while text[q] not in "\"'`":
        q += 1
    n = 3 if text[q] != "`" and b - q >= 6 and text[q] * 3 == text[q : q + 3] == text[b - 3 : b] else 1
    return q + n, b - n, text[q] == "`" or any(c in "fF$" for c in text[a:q])


class _Reader:
    """Assignments of one text, as (name, place, parts); a part is a span, or the name it refers to."""

    def __init__(self, text: str, config: SecretConfig):
        self.text, self.config = text, config
        found = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "x" or not m[0].isspace()]
        self.kind, self.start, self.end = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        self.pairs: list[tuple[str, int, list[tuple[int, int] | str]]] = []

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def is_op(self, i: int, *ops: str) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "o" and self.word(i) in ops

    def string(self, i: int) -> list[tuple[int, int] | str]:
        """Parts of the string at token ``i``: itself, or what its holes leave and refer to."""
        a, b, holes = _inside(self.text, self.start[i], self.end[i])
        if not holes:
            return [(a, b)]
        parts: list[tuple[int, int] | str] = []
        for m in _HOLE.finditer(self.text, a, b):
            parts += [(a, m.start()), m[1]]
            a = m.end()
        return [p for p in [*parts, (a, b)] if isinstance(p, str) or p[1] > p[0]] or [(a, b)]

    def target(self, i: int) -> str | None:
        """The name that the operator at token ``i`` assigns to."""
        j = i - 1
        if j < 0:
            return None
        if self.kind[j] == "s":
            a, b, _ = _inside(self.text, self.start[j], self.end[j])
            return self.text[a:b]
        if self.kind[j] == "w":
            # as in Go, where the type comes after the name: var name Type =
            k = j - 1
            while k > j - 8 and k >= 0 and (self.kind[k] == "w" or self.is_op(k, "[", "]")):
                if self.kind[k] == "w" and self.word(k) in ("var", "const", "val", "let"):
                    return self.word(k + 1)
                k -= 1
            return self.word(j)
        if self.is_op(j, "]"):
            j -= 1
            if j > 0 and self.is_op(j - 1, "[") and self.kind[j] in "sw":
                a, b = _inside(self.text, self.start[j], self.end[j])[:2] if self.kind[j] == "s" else (self.start[j], self.end[j])
                return self.text[a:b]
        return None

    def operand(self, i: int) -> tuple[list[tuple[int, int] | str], int]:
        """Parts of the value that starts at token ``i``, and the token after it."""
        if i >= len(self.kind) or self.kind[i] == "n":
            return [], i
        if self.kind[i] == "s":
            return self.string(i), i + 1
        if self.is_op(i, "("):
            i += 1
            while i < len(self.kind) and self.kind[i] == "n":
                i += 1
            return (self.string(i), i + 1) if i < len(self.kind) and self.kind[i] == "s" else ([], i)
        m = _BARE.match(self.text, self.start[i])
        if not m:
            return [], i
        after = i
        while after < len(self.kind) and self.start[after] < m.end():
            after += 1
        if _IDENT.fullmatch(m[0]):
            if self.is_op(after, "(") and self.start[after] == m.end():
                # a call: its value is known if it wraps a single string that is no name to look up
                if after + 2 < len(self.kind) and self.kind[after + 1] == "s" and self.is_op(after + 2, ")"):
                    a, b, _ = _inside(self.text, self.start[after + 1], self.end[after + 1])
                    return ([] if _NAME_LIKE.fullmatch(self.text, a, b) else self.string(after + 1)), after + 3
                return [], after
            return [m[0]], after
        return [m.span()], after

    def value(self, i: int) -> tuple[list[tuple[int, int] | str], int]:
        """A sum of operands, or neighbouring strings; the token after it."""
        parts, i = self.operand(i)
        while parts and i < len(self.kind):
            j = i + 1 if self.is_op(i, "+") else i if self.kind[i] == self.kind[i - 1] == "s" else 0
            if not j:
                break
            more, after = self.operand(j)
            if not more:
                break
            parts, i = parts + more, after
        return parts, i

    def read(self) -> None:
        i = 0
        while i < len(self.kind):
            after = i + 1
            if self.kind[i] == "o":
                op = self.word(i)
                if op in ("=", ":", ":=", "=>") and not (op == ":" and self.text.startswith("//", self.end[i])):
                    name = self.target(i)
                    if name is not None:
                        if op == ":" and (m := _TYPED.match(self.text, self.end[i])):
                            while after < len(self.kind) and self.start[after] < m.end():
                                after += 1
                        parts, _ = self.value(after)
                        if parts:
                            self.pairs.append((name, self.start[i], parts))
                elif op == "," and 0 < i < len(self.kind) - 1 and self.kind[i - 1] == self.kind[i + 1] == "s":
                    a, b, _ = _inside(self.text, self.start[i - 1], self.end[i - 1])
                    if b - a <= 60 and name_score(name := self.text[a:b]) and " " not in name:
                        self.pairs.append((name, self.start[i], self.string(i + 1)))
            i = after
        if "</" in self.text:
            for m in _ELEMENT.finditer(self.text):
                body = m["body"]
                a = m.start("body") + len(body) - len(body.lstrip())
                for name in (m["tag"], *_CALLED.findall(m["with"])):
                    self.pairs.append((name, m.start(), [(a, a + len(body.strip()))]))
        for m in _NAMED_VALUE.finditer(self.text):
            self.pairs.append((m[1], m.start(), [m.span(2)]))
        self.pairs.sort(key=lambda p: p[1])

    def resolved(self) -> list[list[tuple[int, int]]]:
        """Spans of each pair's value. The first pass knows what was assigned before; in the second a
        name without an assignment before it stands for the first after it."""
        plain = lambda name: name.removeprefix("self.").removeprefix("this.").lstrip("$")
        places: dict[str, list[int]] = {}
        for k, (name, _, _) in enumerate(self.pairs):
            places.setdefault(plain(name), []).append(k)
        values: list[list[tuple[int, int]]] = [[] for _ in self.pairs]
        for second in (False, True):
            for k, (_, _, parts) in enumerate(self.pairs):
                out: list[tuple[int, int]] = []
                for p in parts:
                    if not isinstance(p, str):
                        out.append(p)
                        continue
                    own = places.get(plain(p), ())
                    at = bisect_left(own, k)
                    if at:
                        out += values[own[at - 1]]
                    elif second and (later := [x for x in own[:2] if x != k]):
                        out += values[later[0]]
                    elif not own and len(parts) == 1 and not _NAME_LIKE.fullmatch(p):
                        at = self.text.index(p, self.pairs[k][1])
                        out.append((at, at + len(p)))
                values[k] = out[: self.config.most_parts]
        return values


def lexed(text: str, config: SecretConfig = SecretConfig()) -> list[tuple[str, int, int, float]]:
    """Findings of the assignment-aware lexer, each literal once with its highest score."""
    reader = _Reader(text, config)
    reader.read()
    found: dict[tuple[int, int], float] = {}
    for (name, _, _), spans in zip(reader.pairs, reader.resolved(), strict=True):
        if not spans or not (sensitive := name_score(name)):
            continue
        value = "".join(text[a:b] for a, b in spans)
        if value and (shape := literal_score(value, config)):
            for span in spans:
                found[span] = max(found.get(span, 0.0), sensitive + shape)
    return [("literal", a, b, s) for (a, b), s in sorted(found.items()) if s >= config.threshold and b > a]


def base_spans(text: str, config: SecretConfig = SecretConfig()) -> list[tuple[str, int, int, float]]:
    out = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= config.assign_chars]
    out += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= config.access_chars]
    return out + [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]


def find_spans(text: str, config: SecretConfig = SecretConfig(), lex: bool = True) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind, then end."""
    base = base_spans(text, config)
    more = lexed(text, config) if lex else []
    if more and base:
        base.sort(key=lambda x: x[1])
        starts, reach = [x[1] for x in base], list(accumulate((x[2] for x in base), max))
        # overlaps a base span: one that starts before its end reaches beyond its start
        more = [x for x in more if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scanner(config: SecretConfig):
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            # linear-time filters in one pass each; what they pass is scanned in Python
            named = pc.match_substring_regex(texts, _GROUPS)
            coded = pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, "[0-9a-f]{32}"))
            rows: list[list] = [[] for _ in range(len(keys))]
            for i in pc.indices_nonzero(pc.or_(named, coded)).to_pylist():
                text = texts[i].as_py()
                rows[i] = [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(text, config, named[i].as_py())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(rows, kind_type)], names=[batch.schema.names[0], "spans"])

    return scan


def scan_secrets(docs: DataFrame, config: SecretConfig = SecretConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row; spans carry kind, start, end and score."""
    kind = docs.schema[key].dataType.simpleString()
    picked = lean(docs).select(F.col(key), F.col(text).cast("string").alias("_text"))
    return picked.mapInArrow(_scanner(config), f"`{key}` {kind}, {SCHEMA}")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report of one row per document: counts by base kind, digest of base spans, all spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return scanned.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
