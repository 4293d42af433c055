"""Markdown-like text of search services as plain text: lines are sorted into kinds first, marks inside lines go afterwards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import decode_entities

# Titles of a reference list, and how many characters of body must stand before one for it to end the text.
REFERENCE_TITLES = ["references", "bibliography", "works cited", "notes", "footnotes", "endnotes", "sources", "citations"]
BODY_BEFORE_REFERENCES = 400

_BULLET = r"^(?:[-*+•]|\d{1,9}[.)])\s+"
#: What a line is, tested in this order on the line without indentation and quotation marks; anything else is prose.
_KINDS = {
    "fence": r"^(?:```|~~~)",
    "definition": r"^\[[^\]]+\]:\s+\S",
    "rule": r"^(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,}|=+)$",
    "grid": r"^\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?$",
    "heading": r"^#{1,6}\s",
    "item": _BULLET,
    "row": r"^\||\s\|\s",
}
_SILENT = ["fence", "definition", "rule", "grid"]

#: Bracketed text with at most one pair of brackets inside, and a target in parentheses or brackets.
_LABEL, _TARGET = r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]", r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\])"
_FOOTNOTE = r"\[\[?\^?\d{1,3}\]?\]\(#[^)]*\)|\[\^[^\]\s]+\]"
#: A mark that opens before a non-space and is closed by its like behind one, both at the edge of a word.
_MARKED = r"(?<![\w\\*_~])([*_]{1,3}|~~)(?=\S)([^\n]+?)(?<=\S)\1(?![\w*_~])"
_TAG = r"<(/?[a-zA-Z][^<>]*|!--.*?--)>"


def _kind(line: Column) -> Column:
    kinds = iter(_KINDS.items())
    name, pattern = next(kinds)
    found = F.when(line.rlike(pattern), name)
    for name, pattern in kinds:
        found = found.when(line.rlike(pattern), name)
    return found.otherwise("prose")


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it refers to several times, which is worked out once."""
    return F.transform(F.array(c), use)[0]


def _blocks(lines: Column) -> Column:
    """kind and words of each line.  Each step is worked out once; no lambda refers to the variable of another, which extraction of Python functions would not survive."""
    bare = F.transform(lines, lambda x: F.rtrim(F.regexp_replace(x, r"^\s*(?:>\s?)*\s*", "")))
    known = F.transform(bare, lambda x: F.struct(x.alias("bare"), _kind(x).alias("kind")))
    return F.transform(known, lambda x: _words(x["bare"], x["kind"]))


def _words(bare: Column, kind: Column) -> Column:
    cells = F.array_join(F.filter(F.transform(F.split(bare, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    words = (
        F.when(kind.isin(_SILENT), "")
        .when(kind == "heading", F.regexp_replace(bare, r"^#+\s+|\s+#+$", ""))
        .when(kind == "item", F.regexp_replace(bare, _BULLET, ""))
        .when(kind == "row", cells)
        .otherwise(bare)
    )
    return F.struct(kind.alias("kind"), words.alias("words"))


def _body(blocks: Column) -> Column:
    """The blocks before the first reference title that has enough text above it."""
    title = lambda b: F.regexp_replace(F.lower(b["words"]), r"^[\d.\s]+|[\s:*_]+$|^[*_]+", "").isin(REFERENCE_TITLES)
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("above"), F.lit(0).alias("end"))

    def step(s: Column, b: Column) -> Column:
        ends = (s["end"] == 0) & (s["above"] > BODY_BEFORE_REFERENCES) & title(b)
        return F.struct((s["line"] + 1).alias("line"), (s["above"] + F.length(b["words"])).alias("above"), F.when(ends, s["line"] + 1).otherwise(s["end"]).alias("end"))

    ends = F.aggregate(blocks, start, step, lambda s: s["end"])
    cut = F.struct(blocks.alias("blocks"), ends.alias("end"))
    return _once(cut, lambda c: F.when(c["end"] > 0, F.slice(c["blocks"], F.lit(1), c["end"] - 1)).otherwise(c["blocks"]))


def _plain(words: Column) -> Column:
    """Words without inline marks: pictures and footnote signs vanish, links keep their label, emphasis and code their content."""
    steps = [
        ("!" + _LABEL + _TARGET, ""),
        (_FOOTNOTE, ""),
        (_LABEL + _TARGET, "$1"),
        (r"<((?:https?|mailto):[^<>\s]+)>", "$1"),
        (_TAG, ""),
        (r"(`+)([^`]+)\1", "$2"),
        (_MARKED, "$2"),
        (_MARKED, "$2"),
        (r"\\([!-/:-@\[-`{-~])", "$1"),
    ]
    return reduce(lambda w, s: F.regexp_replace(w, s[0], s[1]), steps, words)


def unmarked(c: Column) -> Column:
    """Plain text, a line a line, with its character references.  Fences, rules, link definitions and the grid lines of tables go; what follows a reference title goes once there is a body."""
    lines = F.split(F.regexp_replace(c, r"\r\n?|(?i:<br\s*/?>)", "\n"), "\n")
    body = _once(_blocks(lines), _body)
    shown = F.filter(body, lambda b: ~b["kind"].isin(_SILENT))
    return _plain(F.array_join(F.transform(shown, lambda b: b["words"]), "\n"))


def strip_markdown(c: Column) -> Column:
    """``unmarked`` with character references decoded.  Decoding refers to its text several times: for large tables put ``unmarked`` into a column of its own first."""
    return decode_entities(unmarked(c))
