from __future__ import annotations

import io
import struct
import zipfile

from tessella.functions import formats as X


def zipped(**entries: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_structured_text():
    assert X.canonical_json('{"b": [1, 2.5], "a": "é"}') == '{"a":"é","b":[1,2.5]}'
    assert X.extract("json", b'{"a": 1, "b": "x y"}') == X.extract("json", b'{ "b":"x y",\n"a":1 }')
    assert X.extract("json", b"{broken one two")[0] == X.shingles("{broken one two")
    assert X.canonical_yaml("b: yes\na: [1, 2020-01-01]\n") == '{"a":[1,"2020-01-01"],"b":"yes"}'
    assert X.canonical_yaml("--- 1\n--- 2\n") == "[1,2]"
    assert len(X.extract("csv", b"a,b\n\"x\ny\",2\na,b\n")[0]) == 2
    assert X.extract("csv", b'a,"b')[0] and X.extract("tsv", b"a\tb\n")[0] != X.extract("csv", b"a\tb\n")[0]


def test_office():
    doc = zipped(**{"word__document.xml": '<w:d xmlns:w="w"><w:t>one two</w:t><w:x>no</w:x><w:t>three</w:t></w:d>', "word__media__i.png": b"img", "docProps__core.xml": "<c/>"})
    assert X.docx_text(doc) == "one two three" and len(X.media_hashes(doc, "docx")) == 1
    slide = '<s xmlns:a="a"><a:t>slide {}</a:t></s>'
    deck = zipped(**{f"ppt__slides__slide{k}.xml": slide.format(k) for k in (10, 2, 1)})
    assert X.pptx_text(deck) == "slide 1 slide 2 slide 10"
    book = zipped(**{
        "xl__sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl__worksheets__sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="s"><v>1</v></c></row></w>',
        "xl__worksheets__sheet2.xml": "<broken",
    })
    assert X.xlsx_rows(book) == [["name", "5"], ["ab"]]


def test_markup():
    assert X.xml_text(b"<a x='no'>one<!-- no --><b>two</b><![CDATA[no]]>three") == ["one", "two", "three"]
    assert X.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}Hello\par \b bold\b0  a\tab b \{x\} \'e9 end}") == "Hello\nbold a\tb {x}  end"


def test_exif():
    date = b"2020:01:02 03:04:05\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0132, 2, len(date), 26) + struct.pack("<I", 0) + date
    assert X.exif_date(tiff) == "2020:01:02 03:04:05" and X.exif_date(b"\xff\xd8..Exif\0\0" + tiff) == "2020:01:02 03:04:05"
    assert X.exif_date(b"no") is None and X.exif_date(b"II*\0\xff\xff") is None


def test_extracted_rows(spark):
    rows = [("a.docx", "docx", b"not a zip"), ("b.txt", "plain_text", b"one two"), ("c", None, b""), ("d.txt", "plain_text", b"  "), ("e", "plain_text", None)]
    got = {r["path"]: r["skip_reason"] for r in X.extracted(spark.createDataFrame(rows, "path string, kind string, content binary")).collect()}
    assert got == {"a.docx": "failed: BadZipFile", "b.txt": None, "c": "unsupported", "d.txt": "empty", "e": "unreadable"}


def test_rtf_notes_and_words_with_marks(spark):
    from pyspark.sql import functions as F

    from tessella.functions import text as T

    assert X.rtf_text(r"{\rtf1 seen{\footnote hidden}{\annotation no}{\field x}{\headerl kept}}") == "seenkept"
    for words in ("हिन्दी भाषा में पाँच शब्द हैं", "naïve e\u0301te\u0301 ½ Ⅳ x_y a-b", "اللُّغَة العربية"):
        column = spark.createDataFrame([(words,)], "t string").select(T.shingle_tokens(F.col("t"))).first()[0]
        assert set(column) == X.shingles(words)


def test_stated_dates(spark):
    from pyspark.sql import functions as F

    from tessella.functions import dates

    core = '<c xmlns:d="d"><d:created>2020-01-01T00:00:00Z</d:created><d:modified>2021-02-03T04:05:06Z</d:modified></c>'
    rows = [
        ("a.docx", "docx", zipped(docProps__core__xml="", **{"docProps__core.xml": core}), 5), ("b.docx", "docx", b"bad", 6),
        ("c.eml", "eml", b"To: x\nDate: Mon, 01 Feb 2021 10:20:07 +0130\n\nhi", 7), ("d.txt", "txt", b"Date: 1 Jan 2020 00:00", 8), ("e.eml", "eml", b"none", 9),
    ]
    files = spark.createDataFrame(rows, "path string, extension string, content binary, mtime_ms long")
    got = X.stated_dates(files).join(files.select("path", "mtime_ms"), "path")
    millis, source = dates.best_date(F.col("raw"), F.col("source"), F.col("mtime_ms"))
    found = {r[0]: (r[1], r[2]) for r in got.select("path", millis, source).collect()}
    fs = "filesystem_modified"
    assert found == {"a.docx": (1612325106000, "office_metadata"), "b.docx": (6, fs), "c.eml": (1612169407000, "email_header"), "d.txt": (8, fs), "e.eml": (9, fs)}
    assert spark.createDataFrame([("2020:01:02 03:04:05",), ("2020:01:02 x",), ("no",)], "x string").select(dates.exif_millis(F.col("x"))).collect() == [(1577934245000,), (1577923200000,), (None,)]
