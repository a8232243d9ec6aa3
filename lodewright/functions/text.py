"""Column expressions over text: white space, lines, patterns, printable share."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as str.split() and str.splitlines() see them.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# The patterns of the quality rules and of the rubric. CONTROL, CP_IO, OPEN_FILE and
# NON_LATIN respect case. \b is that of letters, digits and underscore.
NON_LATIN = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
OS_IO = r"(?iu)\b(subprocess|os\.system|docker|paramiko|scrapy|BeautifulSoup|flask\.|django\.|socket\.socket|powershell)\b"
OTHER_LANG = r"(?iu)(#include\s*<|using namespace|public static void main|fn main\s*\(|func main\s*\(|package main\b|defexn\b)"
CONTROL = r"\b(if|for|while|elif|else|try|except|return)\b"
CP_IO = r"\b(input\s*\(|sys\.stdin|print\s*\()"
UTILITY_IO = r"(?iu)\b(pathlib|os\.path|os\.remove|shutil|requests\.|urllib|BeautifulSoup|selenium|flask|django|tkinter|pygame|argparse|subprocess|socket\.socket)\b"
OPEN_FILE = r"\bopen\s*\("
TUTORIAL = r"(?iu)(how to use|this chapter|pip install|getting started with|in this tutorial)"
ALGO_HINT = r"(?iu)\b(sort|search|graph|dfs|bfs|dp|dynamic programming|greedy|tree|hash|algorithm|complexity|theorem|proof|integral|derivative|matrix|numerical)\b"
MATH_HINT = r"(?iu)(\\frac|\\sum|\\int|prove that|q\.e\.d|therefore)"


def _needles(pattern: str) -> list[str]:
    """What a text must hold for one of the pattern's alternatives to match: their literal beginnings."""
    body = pattern[pattern.index("(", 1 if pattern.startswith("(?") else 0) + 1 : pattern.rindex(")")] if "|" in pattern else pattern
    first = lambda alt: re.split(r"\\s\*|\\b|\\\(", alt.removeprefix("\\b"))[0]
    return [first(alt).replace("\\.", ".").replace("\\\\", "\\") for alt in body.split("|")]


def matches(text: Column, pattern: str) -> Column:
    """Whether one of the fixed patterns of words is found. The regular expression is asked only where the text holds one of its words, which is a fast search."""
    hay = F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik")) if pattern.startswith("(?iu)") else text
    some = functools.reduce(lambda a, b: a | b, [F.contains(hay, F.lit(n.lower() if hay is not text else n)) for n in _needles(pattern)])
    return F.when(some, text.rlike(pattern)).otherwise(F.lit(False))


def non_latin(text: Column) -> Column:
    """Whether the text holds a letter of one of the scripts of ``NON_LATIN``; ASCII texts are not searched."""
    return F.when(F.octet_length(text) > F.length(text), text.rlike(NON_LATIN)).otherwise(F.lit(False))


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def nonempty_lines(text: Column) -> Column:
    """Number of lines that hold something but white space."""
    return F.size(F.filter(F.split(text, LINE_END), lambda x: x.rlike(f"(?s)(?!{SPACE})."))).cast("int")


def is_binary(text: Column, ratio: float = 0.85) -> Column:
    """Holds NUL, or fewer than ``ratio`` of its characters are printable or line marks; empty texts are not binary."""
    printable = F.length(F.regexp_replace(text, r"[[\p{C}\p{Z}]&&[^ \n\r\t]]", ""))
    return F.when(text == "", False).otherwise((F.instr(text, "\0") > 0) | (printable / F.length(text) < ratio))


def is_python3_tag(tag: Column) -> Column:
    """Whether a tag means Python 3: py3, python3 or python, blanks and case aside."""
    return F.coalesce(F.replace(F.lower(tag), F.lit(" "), F.lit("")).isin("py3", "python3", "python"), F.lit(False))


def filled(*columns: Column) -> Column:
    """First column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def reasons(*rules: tuple[str, Column]) -> Column:
    """Array of the codes whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))
