"""Column functions over paths and texts: kinds, keys, word shingles and their measures."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The kind of content for each extension.
KINDS = {
    "txt": "plain_text", "md": "plain_text", "html": "html", "htm": "html", "json": "json", "csv": "csv", "tsv": "tsv",
    "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xml": "xml", "yaml": "yaml", "yml": "yaml", "rtf": "rtf",
}
# Extensions of source code.
SOURCE_EXTENSIONS = "rs py js ts tsx jsx go java kt c h cpp hpp cc cs rb php sh bash swift scala m mm".split()
# Names that a scan leaves out.
IGNORED_NAMES = r"^(\.DS_Store|Thumbs\.db|\._.*|~\$.*)$"
SHINGLE_WORDS = 5


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; null for ``name``, ``.hidden`` and ``name.``-less names."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def is_ignored(path: Column) -> Column:
    return file_name(path).rlike(IGNORED_NAMES)


def kind(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in [*KINDS.items(), *((e, "source_code") for e in SOURCE_EXTENSIONS)] for x in pair))
    return F.try_element_at(table, extension(path))


def path_key(path: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(path, "/")


def normalize_key(path: Column) -> Column:
    """Key under which two platforms see the same path: forward slashes, lower case. Composed forms
    (NFC) need a function outside SQL and are handled by ``nfc`` for texts that are not ASCII."""
    return F.lower(nfc(F.replace(path, F.lit("\\"), F.lit("/"))))


def nfc(text: Column) -> Column:
    """Composed Unicode form; ASCII, which is most, never leaves the JVM's fast path."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return F.when(F.octet_length(text) == F.length(text), text).otherwise(composed(F.when(F.octet_length(text) != F.length(text), text)))


def text_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.transform(F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != ""), F.lower)


def token_hash(token: Column) -> Column:
    """60 bits of a token's MD5, as any SQL engine can compute."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long")


def shingle_tokens(text: Column) -> Column:
    """Distinct hashes of five-word shingles; fewer words are one token, no word is none."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(1), F.greatest(n - SHINGLE_WORDS + 1, F.lit(1)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(F.transform(starts, lambda i: token_hash(F.array_join(F.slice(w, i, SHINGLE_WORDS), " "))))
        )

    return F.element_at(F.transform(F.array(text_words(text)), windows), 1)


def coverage(a: Column, b: Column) -> Column:
    """Share of the set ``a`` that is in ``b``; nothing covers an empty set."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice coefficient of two arrays as sets; null if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total)


def relationship(a_to_b: Column, b_to_a: Column, high: float) -> Column:
    full_a, full_b = a_to_b >= high, b_to_a >= high
    return (
        F.when(full_a & full_b, "near_duplicate").when(full_a, "b_is_more_complete").when(full_b, "a_is_more_complete").otherwise("diverged")
    )
