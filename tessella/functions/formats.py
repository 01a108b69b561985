"""Text, rows, media and dates out of file formats, as plain functions and one Arrow-backed operator.

Row formats give one token a row, all others word shingles. What can't be parsed as its format falls
back to its text (JSON, YAML, CSV, TSV) or is skipped with a reason (office files)."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import struct
import zipfile
from xml.parsers import expat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.functions.text import SHINGLE_WORDS

CELL = "\x1f"
MEDIA = {"docx": "word/media/", "pptx": "ppt/media/", "xlsx": "xl/media/"}
# RTF groups whose content is no text.
RTF_SKIPPED = (
    "fonttbl", "colortbl", "stylesheet", "info", "generator", "pict", "object", "footer", "header", "footnote", "annotation",
    "field", "themedata", "colorschememapping", "latentstyles", "rsidtbl", "xmlnstbl", "listtable", "listoverridetable", "datastore",
)
#: As ``text_words`` splits: letters with the marks that count as alphabetic, and numbers.
_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def token(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def shingles(text: str) -> set[int]:
    words = [w.lower() for w in _WORDS.findall(text)]
    n = max(len(words) - SHINGLE_WORDS + 1, 1)
    return {token(" ".join(words[i : i + SHINGLE_WORDS])) for i in range(n)} if words else set()


def read_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def row_tokens(data: bytes, delimiter: str) -> set[int]:
    rows = csv.reader(io.StringIO(data.decode("utf-8"), newline=""), delimiter=delimiter, strict=True)
    return {token(CELL.join(r)) for r in rows if r}


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def canonical_json(text: str) -> str:
    """Sorted keys and no white space, so that layout and order don't matter."""
    return json.dumps(json.loads(text, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_yaml(text: str) -> str:
    """YAML documents as canonical JSON, by YAML 1.2's idea of scalars: ``yes`` and dates stay strings."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {
        c: [(tag, rx) for tag, rx in rules if tag.rsplit(":", 1)[-1] in ("int", "float", "null")] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def plain(x):
        if isinstance(x, dict):
            return {k if isinstance(k, str) else repr(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return str(x)
        return x if isinstance(x, (str, int, float, bool, type(None))) else None

    found = [plain(d) for d in yaml.load_all(text, Loader)]
    return json.dumps(found[0] if len(found) == 1 else found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def xml_text(data: bytes, tag: str | None = None) -> list[str]:
    """Text runs, of all elements or those with a local name; a malformed end keeps what came before."""
    # unbuffered, as a buffer's content would be lost with an error; pieces of a run are put together
    parser, runs, depth, quoted, fresh = expat.ParserCreate(), [], [0], [False], [True]

    def start(name, _):
        depth[0] += name.rpartition(":")[2] == tag
        fresh[0] = True

    def end(name):
        depth[0] -= name.rpartition(":")[2] == tag
        fresh[0] = True

    def chars(s):
        if not quoted[0] and (tag is None or depth[0]):
            if fresh[0]:
                runs.append(s)
            else:
                runs[-1] += s
            fresh[0] = False

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.CommentHandler = lambda _: fresh.__setitem__(0, True)
    parser.StartCdataSectionHandler = lambda: (quoted.__setitem__(0, True), fresh.__setitem__(0, True))
    parser.EndCdataSectionHandler = lambda: quoted.__setitem__(0, False)
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass
    return runs


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return " ".join(xml_text(z.read("word/document.xml"), "t"))


def pptx_text(data: bytes) -> str:
    """Slides by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        return " ".join(run for _, n in sorted(slides) for run in xml_text(z.read(n), "t"))


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cell values of every row of every sheet; a sheet that doesn't parse is skipped."""
    import xml.etree.ElementTree as ET

    local = lambda e: e.tag.rpartition("}")[2]
    rows: list[list[str]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if local(t) == "t"))
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            try:
                sheet = ET.fromstring(z.read(name))
            except ET.ParseError:
                continue
            for row in (e for e in sheet.iter() if local(e) == "row"):
                cells = []
                for cell in row:
                    value = "".join(t.text or "" for t in cell.iter() if local(t) in ("v", "t"))
                    cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                rows.append(cells)
    return rows


def rtf_text(text: str) -> str:
    """Text of an RTF document: groups of tables and pictures are skipped, paragraphs become newlines."""
    out, stack, skip = [], [], False
    for m in re.finditer(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'[0-9a-fA-F]{2}|\\([^a-zA-Z])|([{}])|([^\\{}]+)", text):
        word, _, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in RTF_SKIPPED:
            skip = True
        elif not skip:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif symbol is not None and symbol in "\\{}":
                out.append(symbol)
            elif plain:
                out.append(plain.replace("\r", "").replace("\n", ""))
    return "".join(out)


def media_hashes(data: bytes, kind: str) -> list[str]:
    """Hashes of embedded media; an entry that can't be read is skipped."""
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if n.startswith(MEDIA[kind]) and not n.endswith("/"):
                try:
                    found.append(hashlib.sha256(z.read(n)).hexdigest())
                except (zipfile.BadZipFile, OSError):
                    continue
    return found


def exif_date(data: bytes) -> str | None:
    """DateTimeOriginal, else DateTime, of a JPEG's or TIFF's tags."""
    at = data.find(b"Exif\0\0")
    tiff = data[at + 6 :] if at >= 0 else data
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return None

    def tags(offset: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", tiff, offset)
        return {t: (kind, count, offset + 2 + 12 * k + 8) for k in range(n) for t, kind, count in [struct.unpack_from(order + "HHI", tiff, offset + 2 + 12 * k)]}

    def text(entry: tuple[int, int, int]) -> str:
        _, count, place = entry
        where = struct.unpack_from(order + "I", tiff, place)[0] if count > 4 else place
        return tiff[where : where + count].rstrip(b"\0").decode("ascii", "replace")

    try:
        first = tags(struct.unpack_from(order + "I", tiff, 4)[0])
        if 0x8769 in first:
            inner = tags(struct.unpack_from(order + "I", tiff, first[0x8769][2])[0])
            if 0x9003 in inner:
                return text(inner[0x9003])
        return text(first[0x0132]) if 0x0132 in first else None
    except struct.error:
        return None


def zip_text(data: bytes, name: str) -> str | None:
    """One entry of an archive as text; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return read_text(z.read(name))
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError):
        return None


def first_tag_text(text: str, tag: str) -> str | None:
    """The text of the first element with a local name, if it has any."""
    runs = [r.strip() for r in xml_text(text.encode("utf-8", "surrogatepass"), tag)]
    return next((r for r in runs if r), None)


def raw_date(extension: str | None, data: bytes | None) -> tuple[str | None, str | None]:
    """The date that a file states, as it is written there, and where it comes from."""
    if data is None:
        return None, None
    if extension in ("docx", "pptx", "xlsx"):
        core = zip_text(data, "docProps/core.xml")
        found = core and (first_tag_text(core, "modified") or first_tag_text(core, "created"))
        return (found, "office_metadata") if found else (None, None)
    if extension in ("jpg", "jpeg", "tiff"):
        found = exif_date(data)
        return (found, "exif") if found else (None, None)
    if extension == "eml":
        for line in read_text(data).splitlines():
            if line.startswith(("Date:", "date:")):
                return line[5:].strip(), "email_header"
    return None, None


def stated_dates(files: DataFrame) -> DataFrame:
    """(path, raw, source) of files (path, extension, content): dates as written, null where there is none."""

    def run(batches):
        for batch in batches:
            got = [raw_date(e, d) for e, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.string())], names=["path", "raw", "source"]
            )

    return files.select("path", "extension", "content").mapInArrow(run, "path string, raw string, source string")


def extract(kind: str, data: bytes) -> tuple[set[int], list[str]]:
    """(tokens, media hashes) of content of a kind."""
    text = lambda: shingles(read_text(data))
    try:
        if kind == "json":
            return shingles(canonical_json(read_text(data))), []
        if kind == "yaml":
            return shingles(canonical_yaml(read_text(data))), []
        if kind in ("csv", "tsv"):
            return row_tokens(data, "," if kind == "csv" else "\t"), []
    except Exception:  # noqa: BLE001  any error of a parser: the whole text stands for it
        return text(), []
    if kind == "docx":
        return shingles(docx_text(data)), media_hashes(data, kind)
    if kind == "pptx":
        return shingles(pptx_text(data)), media_hashes(data, kind)
    if kind == "xlsx":
        return {token(CELL.join(r)) for r in xlsx_rows(data)}, media_hashes(data, kind)
    if kind == "xml":
        return shingles(" ".join(xml_text(data))), []
    if kind == "rtf":
        return shingles(rtf_text(read_text(data))), []
    return text(), []


def extracted(files: DataFrame) -> DataFrame:
    """(path, tokens, media, skip_reason) of files (path, kind, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens, media, reason = set(), [], None
                if kind is None:
                    reason = "unsupported"
                elif data is None:
                    reason = "unreadable"
                else:
                    try:
                        tokens, media = extract(kind, data)
                        reason = None if tokens else "empty"
                    except Exception as e:  # noqa: BLE001  one bad file never ends a scan
                        reason = f"failed: {type(e).__name__}"
                rows.append((path, sorted(tokens), media, reason))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "tokens", "media", "skip_reason"])

    return files.select("path", "kind", "content").mapInArrow(run, "path string, tokens array<long>, media array<string>, skip_reason string")
