"""Coding systems, strings that hold several codes, and codelists."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Code:
    """A code of one system; codes of different systems, and strings, never compare."""

    value: str
    pattern = r".*"

    def __post_init__(self):
        if not re.fullmatch(self.pattern, self.value, re.ASCII):
            raise ValueError(f"invalid {type(self).__name__}: {self.value!r}")

    def __str__(self) -> str:
        return self.value


# The published forms of the codes of each system.


class BNFCode(Code):
    pattern = r"[01]\d{6}[0-9A-Z]{2}([A-Z][0-9A-Z]){3}|2[0-3]\d{9}"


class CTV3Code(Code):
    pattern = r"[0-9A-Za-z]{5}|[0-9A-Za-z]{4}\.|[0-9A-Za-z]{3}\.\.|[0-9A-Za-z]{2}\.\.\."


class ICD10Code(Code):
    pattern = r"[A-Z]\d\d(X\d?|\d{0,2})"


class OPCS4Code(Code):
    pattern = r"[A-HJ-Z]\d{2,3}"


class SNOMEDCTCode(Code):
    pattern = r"[1-9]\d{5,17}"


class DMDCode(Code):
    pattern = r"[1-9]\d{5,17}"


@dataclass(frozen=True)
class MultiCodeString:
    """Several codes of ``code`` run together in one string; it can only be searched, by a code or its beginning."""

    value: str
    code = Code
    prefix = r".*"

    @classmethod
    def part(cls, text: str | Code) -> str:
        if isinstance(text, Code) and type(text) is not cls.code:
            raise TypeError(f"{cls.__name__} holds {cls.code.__name__}, not {type(text).__name__}")
        if not re.fullmatch(cls.prefix, str(text), re.ASCII):
            raise ValueError(f"{text!r} is neither a {cls.code.__name__} nor the beginning of one")
        return str(text)


class ICD10MultiCodeString(MultiCodeString):
    code, prefix = ICD10Code, r"[A-Z](\d{0,4}|\d\dX\d?)"


class OPCS4MultiCodeString(MultiCodeString):
    code, prefix = OPCS4Code, r"[A-HJ-Z]\d{0,3}"


def any_of_pattern(parts: list[str]) -> str:
    """A regular expression for text that holds any of the parts: a tree of their beginnings, so that long lists are searched letter by letter."""
    tree: dict = {}
    for part in sorted(parts):  # a beginning comes before what it begins
        node = tree
        for c in part:
            if None in node:
                break  # what goes on from a whole part adds nothing
            node = node.setdefault(c, {})
        else:
            node[None] = True

    def pattern(node: dict) -> str:
        if None in node:
            return ""
        branches = [re.escape(c) + pattern(below) for c, below in node.items()]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return pattern(tree)


def codelist_from_csv(filename, *, column: str, category_column: str | None = None) -> list[str] | dict[str, str]:
    """The codes of a CSV file's column, or a dict from codes to categories; blanks go, white space around codes too."""
    path = Path(filename)
    if not path.exists():
        raise FileNotFoundError(f"no codelist file {path}")
    with path.open(newline="", encoding="utf-8-sig") as f:
        rows = csv.DictReader(f)
        for name in filter(None, (column, category_column)):
            if name not in (rows.fieldnames or []):
                raise ValueError(f"no column {name!r} in {path}")
        pairs = [(r[column].strip(), (r[category_column] or "").strip() if category_column else None) for r in rows if (r[column] or "").strip()]
    return dict(pairs) if category_column else list(dict.fromkeys(c for c, _ in pairs))
