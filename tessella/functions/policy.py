"""Preflight rules for destination paths, as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that some platforms reserve, and characters they don't allow.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10))]
ILLEGAL = r'[:*?"<>|]'


@dataclass(frozen=True)
class PreflightRules:
    max_path_bytes: int = 255
    fat32_limit: int | None = None


def path_issues(path: Column, size: Column | None = None, rules: PreflightRules = PreflightRules()) -> Column:
    """Issues of a relative path, as sorted strings ``kind`` or ``kind:detail``."""
    parts = F.split(path, "/")
    stem = lambda p: F.lower(F.substring_index(p, ".", 1))
    issues = F.concat(
        F.when(F.octet_length(path) > rules.max_path_bytes, F.array(F.lit("path_too_long"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_distinct(F.regexp_extract_all(path, F.lit(f"({ILLEGAL})"), 1)), lambda c: F.concat(F.lit("illegal_character:"), c)),
        F.transform(F.filter(parts, lambda p: stem(p).isin(RESERVED)), lambda p: F.concat(F.lit("reserved_name:"), p)),
        F.transform(F.filter(parts, lambda p: p.rlike(r"[. ]$")), lambda p: F.concat(F.lit("trailing_dot_or_space:"), p)),
    )
    if size is not None and rules.fat32_limit is not None:
        issues = F.concat(issues, F.when(size > rules.fat32_limit, F.array(F.lit("file_too_large"))).otherwise(F.array().cast("array<string>")))
    return F.sort_array(issues)
