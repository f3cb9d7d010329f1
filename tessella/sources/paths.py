"""Input arguments: files and glob patterns."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make an argument a pattern.
GLOB = r"[*?\[\]]"


def has_glob_characters(text: str) -> bool:
    return bool(re.search(GLOB, text))


def has_glob_column(name: str) -> Column:
    return F.col(name).rlike(GLOB)


def check_pattern(text: str) -> None:
    """An error for a malformed pattern: three stars in a row, two that are not a whole part
    of the path, or a bracket that is not closed (one right after the opening is a member)."""
    for stars in re.finditer(r"\*{2,}", text):
        if len(stars[0]) > 2:
            raise ValueError(f"{text!r}: wildcards are one star, or two for any depth")
        if text[: stars.start()][-1:] not in ("", "/") or text[stars.end() :][:1] not in ("", "/"):
            raise ValueError(f"{text!r}: two stars must be a whole part of the path")
    at = text.find("[")
    while at >= 0:
        start = at + (2 if text[at + 1 : at + 2] == "!" else 1)
        end = text.find("]", start + 1)
        if end < 0:
            raise ValueError(f"{text!r}: a bracket is not closed")
        at = text.find("[", end)


def resolve_inputs(arguments: list[str]) -> list[str]:
    """Sorted different paths; an argument without a file is an error. Patterns match names
    with a leading dot too, and two stars any depth."""
    if not arguments:
        raise ValueError("no input files given")
    out: list[str] = []
    for a in arguments:
        check_pattern(a)
        hits = [p for p in glob.glob(a, recursive=True, include_hidden=True) if os.path.isfile(p)] or ([a] if os.path.isfile(a) else [])
        if not hits:
            raise FileNotFoundError(f"no file matches the pattern {a!r}" if has_glob_characters(a) else f"no such file: {a!r}")
        out += hits
    return sorted(set(out))
