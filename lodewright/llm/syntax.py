"""Problem 6: source files that do not parse, by a generalised LL recogniser.

A file is cut into tokens of its language and recognised by that language's grammar; all dialects of
a language (start rules) run together, a file is flagged if every dialect rejects it. Python files are
recognised in two layers, logical lines and the block structure of lines. Verdicts are memoised by
token sequence (identifiers, numbers and strings count as kinds), so files of one shape cost one parse;
rejected Python files are confirmed with the interpreter's own parser, as that is what "Python 3"
means here.

Defined results: rows with a null or empty file or a null or blank tag are no case and are not counted in the
rates. A tag of no supported language is no case either, but its files are counted under that tag, as
not checked (``parses`` null). Texts of any length are read whole. Repeated rows come out repeatedly.
"""

from __future__ import annotations

import ast
import re
import warnings
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm import grammars
from lodewright.llm.common import spread
from lodewright.llm.gll import Grammar

# Spellings of the tags, lower case without blanks.
LANGUAGES = {
    "python": ("python", "python3", "py", "py3", "cpython", "python3.11", "python3.12", "python3.13"),
    "cpp": ("cpp", "c++", "c++11", "c++14", "c++17", "c++20", "c++23", "cxx", "cpp17", "cpp20", "cpp23"),
    "c": ("c", "c89", "c99", "c11", "c17", "c23", "ansic"),
    "java": ("java", "java8", "java11", "java17"),
    "javascript": ("javascript", "js", "node", "nodejs", "ecmascript"),
    "go": ("go", "golang"),
}
MAX_SHAPES = 100_000
_NUMBER = r"0[xX][0-9a-fA-F_'.]+(?:[pP][+-]?\d+)?\w*|0[bBoO][0-9_']+\w*|(?:\d[\d_']*\.?[\d_']*|\.\d[\d_']*)(?:[eE][+-]?\d+)?\w*"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHAR = r"'(?:[^'\\\n]|\\[\s\S])+'"
_NAME = r"[^\W\d]\w*"
_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"


class Language:
    """A brace language: its token pattern and grammar, of which all start rules run together."""

    def __init__(self, grammar: Grammar, pattern: str, name: str = _NAME) -> None:
        self.grammar = grammar
        known = self.grammar.terminals
        ops = sorted((t for t in known if not re.match(r"\w", t) and t != "$"), key=len, reverse=True)
        self.pattern = re.compile("|".join([pattern, name, *map(re.escape, ops), r"\s+|."]), re.S)
        self.known = known
        self.shapes: dict[bytes, bool] = {}

    def kind(self, t: str) -> int | None:
        """Terminal number; None for blanks and comments, -1 for what is no token."""
        c = t[0]
        if c.isspace() or (t[:2] in ("//", "/*") and len(t) > 1):
            return None
        if c.isdigit() or (c == "." and t[1:2].isdigit()):
            return self.known["NUM"]
        if (c == '"' or t[-1:] == '"') and len(t) > 1:
            return self.known["STR"]
        if c == "'" and len(t) > 2:
            return self.known.get("CHAR", self.known["STR"])
        if c == "_" or c == "$" or c.isalpha():
            return self.known["ID"]
        return -1

    def tokens(self, text: str) -> list[int]:
        memo, kind, out = self.known, self.kind, []
        for t in self.pattern.findall(text):
            k = memo.get(t)
            if k is None:
                k = kind(t)
                if k is None:
                    continue
            out.append(k)
        return out

    def readings(self, text: str) -> Iterator[list[int]]:
        """The token sequences the text may stand for; one of them has to be accepted."""
        yield self.tokens(text)

    def accepts(self, text: str) -> bool:
        return any(map(self._accepted, self.readings(text)))

    def _accepted(self, tokens: list[int]) -> bool:
        if -1 in tokens:
            return False
        shape = array("H", tokens).tobytes()
        got = self.shapes.get(shape)
        if got is None:
            if len(self.shapes) >= MAX_SHAPES:
                self.shapes.clear()
            got = self.shapes[shape] = self.grammar.recognise(tokens)
        return got


class _Java(Language):
    def __init__(self) -> None:
        grammar = Grammar(grammars.JAVA, ("unit", "compact", "modular"), ("block", "classbody", "recordbody", "enumbody", "switchbody"), ("simple",))
        super().__init__(grammar, rf'{_COMMENT}|"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_STRING}|{_CHAR}|{_NUMBER}', r"[^\W\d]\w*|\$\w+")
        number = lambda *ts: {self.known[t] for t in ts}
        self._context = number("record", "sealed", "non", "permits", "yield", "when", "open", "module")
        self._modifiers = number("public", "private", "protected", "static", "abstract", "strictfp", "class", "interface", "@")
        self._begins = number(";", "{", "}", ":", "->", ")") | {0}
        self._goes_on = number("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ".", "[", "->", "::", ",", ";", ")")

    def tokens(self, text: str) -> list[int]:
        """Words that are keywords only where they fit are names elsewhere."""
        out = super().tokens(text)
        if self._context.isdisjoint(out):
            return out
        known = self.known
        name = known["ID"]
        for i, k in enumerate(out):
            if k not in self._context:
                continue
            before, after, third = out[i - 1] if i else 0, out[i + 1] if i + 1 < len(out) else 0, out[i + 2] if i + 2 < len(out) else 0
            fits = (
                (k == known["record"] and after == name and third in (known["("], known["<"]))
                or (k == known["sealed"] and after in self._modifiers)
                or (k == known["non"] and after == known["-"] and third == known["sealed"])
                or (k == known["permits"] and after == name and before in (name, known[">"]))
                or (k == known["yield"] and before in self._begins and after not in self._goes_on)
                or (k == known["when"] and before in (name, known[")"]) and after not in self._goes_on)
                or (k == known["open"] and after == known["module"])
                or (k == known["module"] and before in self._begins | {known["open"]} and after == name and third in (known["."], known["{"]))
            )
            if not fits:
                out[i] = name
        return out


class _Cpp(Language):
    """C++, or C. Preprocessor lines are dropped; where conditions choose between branches, all branches, the first or the last must be accepted."""

    _branch = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|else|elif|elifdef|elifndef|endif)\b")
    _macro = re.compile(r"[A-Z_][A-Z0-9_]*[A-Z0-9]")

    def __init__(self, start: str = "cpp") -> None:
        directive = r"(?m:^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)"
        grammar = Grammar(grammars.CPP, (start,), ("space", "members", "body", "braces", "kbody", "kbraces"), ("local", "klocal"))
        super().__init__(grammar, rf'{directive}|{_COMMENT}|(?:u8|[uUL])?R"(\w*)\([\s\S]*?\)\1"|(?:u8|[uUL])?{_STRING}|(?:u8|[uUL])?{_CHAR}|{_NUMBER}')
        # One group would make findall return groups.
        self._finditer = self.pattern.finditer
        known = self.known
        self._mark = {known[t] for t in (";", "}", "{", ":")}
        self._not_macro = {known[t] for t in known if not re.match(r"\w", t) and t != "$" and t not in ("~", "::", "[")} - {known["}"]}

    def tokens(self, text: str) -> list[int]:
        return self._tokens(text, False)

    def _tokens(self, text: str, no_macros: bool) -> list[int]:
        memo, out, macros = self.known, [], []
        for m in self._finditer(text):
            t = m[0]
            k = memo.get(t)
            if k is None:
                if t.lstrip(" \t")[:1] == "#" and len(t) > 1:
                    continue
                if (k := self.kind(t)) is None:
                    continue
                if no_macros and self._macro.fullmatch(t):
                    macros.append(len(out))
            out.append(k)
        return self._without(out, macros) if macros else out

    def _without(self, out: list[int], macros: list[int]) -> list[int]:
        """The tokens without macros that stand as declarations: ``NAME`` or ``NAME(...)`` where one may begin and with something that begins one, or nothing, behind."""
        known, drop = self.known, set()
        for i in macros:
            before = next((out[j] for j in range(i - 1, -1, -1) if j not in drop), known[";"])
            if before not in self._mark:
                continue
            j = i + 1
            if j < len(out) and out[j] == known["("]:
                depth = 0
                while j < len(out):
                    depth += (out[j] == known["("]) - (out[j] == known[")"])
                    j += 1
                    if not depth:
                        break
                if j < len(out) and out[j] == known[";"]:
                    j += 1
                elif j < len(out) and out[j] in self._not_macro:
                    continue
            elif j < len(out) and (out[j] in self._not_macro or out[j] == known["ID"]):
                continue
            drop.update(range(i, j))
        return [k for i, k in enumerate(out) if i not in drop]

    def readings(self, text: str) -> Iterator[list[int]]:
        texts = [text]
        if "#" in text and re.search(r"(?m)^[ \t]*#[ \t]*el(?:se|if)", text):
            texts += [self._chosen(text, last) for last in (False, True)]
        for t in texts:
            yield self.tokens(t)
        for t in texts:
            yield self._tokens(t, True)

    def _chosen(self, text: str, last: bool) -> str:
        """The text with the first, or the last, branch of every condition."""
        lines = text.split("\n")
        stack: list[list] = []  # of each open condition: the lines of its branches
        out: list[str] = []
        for line in lines:
            m = self._branch.match(line)
            if m and m[1].startswith("if"):
                stack.append([[]])
            elif m and stack and m[1] != "endif":
                stack[-1].append([])
            elif m and stack:
                branches = stack.pop()
                (stack[-1][-1] if stack else out).extend(branches[-1 if last else 0])
            else:
                (stack[-1][-1] if stack else out).append(line)
        for branches in stack:
            out.extend(branches[-1 if last else 0])
        return "\n".join(out)


class _Go(Language):
    """Go, with its automatic semicolons."""

    _ends = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}

    def __init__(self) -> None:
        super().__init__(Grammar(grammars.GO, ("file",), ("block", "cases", "comms", "litval"), ("plain",)), rf"{_COMMENT}|`[^`]*`|{_STRING}|{_CHAR}|{_NUMBER}")

    def tokens(self, text: str) -> list[int]:
        known, out, may_end = self.known, [], False
        semicolon, plain = known[";"], {known["ID"], known["NUM"], known["STR"], known["CHAR"]}
        for t in self.pattern.findall(text + "\n"):
            k = known.get(t)
            if k is None:
                k = known["STR"] if t[0] == "`" and len(t) > 1 else self.kind(t)
                if k is None:
                    if may_end and "\n" in t:
                        out.append(semicolon)
                        may_end = False
                    continue
            out.append(k)
            may_end = k in plain or t in self._ends
        return out


class _JavaScript(Language):
    """JavaScript; a line end that may end a statement is a token of its own."""

    _regex_after = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await"}
    _ends = {")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "return", "break", "continue", "debugger", "yield", "async", "let", "static", "of", "get", "set", "from", "as", "await"}
    _goes_on = set(". , ; ) ] ? : ( [ { } * / % & | ^ && || ?? == != === !== < > <= >= << >> >>> = += -= *= /= %= **= => ?. in of instanceof catch finally + - **".split())

    def __init__(self) -> None:
        plain = ("start", "plain", "top", "local")
        grammar = Grammar(grammars.JAVASCRIPT, ("script", "module"), ("body", "classbody", "cases"), ("top", "local"), (";", "NL"), dict.fromkeys(plain, ("{", "function", "class")))
        super().__init__(grammar, rf"<!--[^\n]*|{_COMMENT}|{_STRING}|'(?:[^'\\\n]|\\[\s\S])*'|{_NUMBER}", r"[^\W\d$][\w$]*|\$[\w$]*")
        self._regex = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")

        number = lambda *ts: {self.known[t] for t in ts}
        self._context = number("get", "set", "of", "from", "as")
        self._keys = number("ID", "STR", "NUM", "[", "#", "async", "let", "static", "get", "set", "of", "from", "as")
        self._words = {k for t, k in self.known.items() if re.match(r"[a-z]", t)}
        self._members = number("{", "}", ",", ";", "NL", "static")

    def tokens(self, text: str) -> list[int]:
        out: list[int] = []
        if text[:2] == "#!":
            text = text[text.find("\n") :] if "\n" in text else ""
        if self._scan(text, 0, out, "") != len(text):
            return [-1]
        return self._names(out)

    def _names(self, out: list[int]) -> list[int]:
        """Words that are keywords only where they fit are names elsewhere."""
        if self._context.isdisjoint(out):
            return out
        known = self.known
        name = known["ID"]
        for i, k in enumerate(out):
            if k not in self._context:
                continue
            before, after = out[i - 1] if i else 0, out[i + 1] if i + 1 < len(out) else 0
            if k in (known["get"], known["set"]):
                fits = before in self._members and (after in self._keys or after in self._words)
            elif k == known["of"]:
                fits = before in (name, known["]"], known["}"]) and after not in (known[";"], known[","], known[")"], known["="], known["."], known["NL"], 0)
            elif k == known["from"]:
                fits = after == known["STR"] and before in (known["}"], name, known["*"])
            else:
                fits = (after == name or after in self._words or after == known["STR"]) and (before == name or before in self._words or before in (known["*"], known["STR"]))
            if not fits:
                out[i] = name
        return out

    def _scan(self, text: str, at: int, out: list[int], until: str) -> int:
        """Tokens from ``at`` up to the closing brace of a template's hole, or the end."""
        known, match = self.known, self.pattern.match
        before, line, depth = "", False, []
        while at < len(text):
            c = text[at]
            if c == "`":
                at = self._template(text, at + 1)
                if at < 0:
                    return -1
                t, k = "``", known["TPL"]
            elif c == "/" and (m := self._regex.match(text, at)) and not self._operand_before(before):
                t, k = m[0], known["REGEX"]
                at = m.end()
            else:
                m = match(text, at)
                t = m[0]
                at = m.end()
                if until and t == "}" and not depth:
                    return at
                k = known.get(t)
                if k is None:
                    k = known["STR"] if t[0] == "'" and len(t) > 1 else None if t[:4] == "<!--" else self.kind(t)
                    if k is None:
                        line = line or "\n" in t
                        continue
            if line and (not depth or depth[-1] == "{") and t not in self._goes_on and (before in self._ends or before == "x"):
                out.append(known["NL"])
            line = False
            if t in ("(", "[", "{"):
                depth.append(t)
            elif t in (")", "]", "}") and depth:
                depth.pop()
            out.append(k)
            before = t if t in known and k != known["ID"] else "x"
        return -1 if until else at

    @staticmethod
    def _operand_before(before: str) -> bool:
        return before in ("x", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--")

    def _template(self, text: str, at: int) -> int:
        while at < len(text):
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif c == "$" and text[at + 1 : at + 2] == "{":
                inner: list[int] = []
                at = self._scan(text, at + 2, inner, "}")
                if at < 0 or -1 in inner:
                    return -1
                e = self.known
                if not self._accepted([e["("], *self._names([k for k in inner if k != e["NL"]]), e[")"]]):
                    return -1
            else:
                at += 1
        return -1


class _Python:
    """Python 3: logical lines, then blocks of lines."""

    def __init__(self) -> None:
        line = grammars.PYTHON_LINE
        self.grammars = {s: Grammar(line, (s,)) for s in ("simple", "header", "block", "decorator", "case", "exprs", "expression")}
        self.known = self.grammars["simple"].terminals
        self.file = Grammar(grammars.PYTHON_FILE, ("file",))
        ops = sorted((t for t in self.known if not re.match(r"\w", t) and t != "$"), key=len, reverse=True)
        prefix = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
        number = r"0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?!\w)|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])(?!\w)|(?:0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)"
        self.pattern = re.compile(
            "|".join([
                rf'{prefix}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', rf"{prefix}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", rf'{prefix}"(?:[^"\\\n]|\\[\s\S])*"(?!"")', rf"{prefix}'(?:[^'\\\n]|\\[\s\S])*'(?!'')", rf"{prefix}\"\"(?!\")", rf"{prefix}''(?!')",
                number, _NAME, r"\#[^\n]*", r"\n[ \t\f]*", r"[ \t\f]+", r"\\\n", *map(re.escape, ops), r"[\s\S]",
            ])
        )
        self.lines: dict[bytes, str] = {}
        self.files: dict[tuple[str, ...], bool] = {}

    def _field(self, text: str) -> bool:
        """Whether the replacement fields of an f-string's inside are expressions."""
        at, n = 0, len(text)
        while at < n:
            c = text[at]
            if c == "{":
                if text[at + 1 : at + 2] == "{":
                    at += 2
                    continue
                depth, i = 0, at + 1
                while i < n:
                    d = text[i]
                    if d in "([{":
                        depth += 1
                    elif d in ")]}":
                        if not depth:
                            break
                        depth -= 1
                    elif d in "'\"":
                        i = text.find(d, i + 1)
                        if i < 0:
                            return False
                    elif not depth and (d == ":" or (d == "!" and text[i + 1 : i + 2] != "=")):
                        break
                    i += 1
                if i >= n or text[i] not in "}:!":
                    return False
                inside = text[at + 1 : i].strip()
                if inside.endswith("=") and inside[-2:-1] not in ("=", "!", "<", ">"):
                    inside = inside[:-1]
                tokens = self._plain(inside)
                if tokens is None or not self._is("expression", tokens):
                    return False
                if text[i] == "!":
                    if text[i + 1 : i + 2] not in ("r", "s", "a") or text[i + 2 : i + 3] not in (":", "}"):
                        return False
                    i += 2
                if text[i] == ":":
                    j, depth = i + 1, 0
                    while j < n and (depth or text[j] != "}"):
                        depth += {"{": 1, "}": -1}.get(text[j], 0)
                        j += 1
                    if j >= n or not self._field(text[i + 1 : j]):
                        return False
                    i = j
                at = i + 1
            elif c == "}":
                if text[at + 1 : at + 2] != "}":
                    return False
                at += 2
            else:
                at += 1
        return True

    def _kind(self, t: str) -> int | None:
        c = t[0]
        if c in " \t\f\n#" or t == "\\\n":
            return None
        if t[-1] in "'\"" and len(t) > 1:
            head = t[: 3 if len(t) > 3 else len(t)].lower()
            q = min(i for i in (t.find("'"), t.find('"')) if i >= 0)
            if "b" in head[:q]:
                return self.known["BYTES"] if t.isascii() else -1
            if "f" in head[:q]:
                w = 3 if t[q : q + 3] in ('"""', "'''") and len(t) >= q + 6 else 1
                if not self._field(t[q + w : -w]):
                    return -1
            return self.known["STR"]
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return self.known["NUM"]
        if t.isidentifier():
            return self.known["ID"]
        return -1

    def _plain(self, text: str) -> list[int] | None:
        out = []
        for t in self.pattern.findall(text):
            k = self.known.get(t)
            if k is None and (k := self._kind(t)) is None:
                continue
            if k < 0:
                return None
            out.append(k)
        return out

    def _is(self, start: str, tokens: list[int]) -> bool:
        key = start.encode() + b"".join(k.to_bytes(2, "little") for k in tokens)
        got = self.lines.get(key)
        if got is None:
            got = self._remember(key, "y" if self.grammars[start].recognise(tokens) else "n")
        return got == "y"

    def _remember(self, key: bytes, value: str) -> str:
        if len(self.lines) >= MAX_SHAPES:
            self.lines.clear()
        self.lines[key] = value
        return value

    _headers = {"if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class"}

    def _line(self, tokens: list[int], first: str, second: str) -> str:
        """Kind of a logical line: a block keyword (with ``+`` if its body is on the line), LINE, @ or empty if it is none."""
        key = bytes([0, first in ("match", "case")]) + (first.encode() if first in ("match", "case") else b"") + b"".join(k.to_bytes(2, "little") for k in tokens)
        got = self.lines.get(key)
        return got if got is not None else self._remember(key, self._line_kind(tokens, first, second))

    def _line_kind(self, tokens: list[int], first: str, second: str) -> str:
        g, colon = self.grammars, self.known[":"]
        word = second if first == "async" else first
        if word in self._headers:
            if not g["block"].recognise(tokens):
                return ""
            return word if tokens[-1] == colon and g["header"].recognise(tokens[:-1]) else word + "+"
        if first == "@":
            return "@" if g["decorator"].recognise(tokens) else ""
        if first in ("match", "case") and tokens[-1] == colon and len(tokens) > 2:
            if g["exprs" if first == "match" else "case"].recognise(tokens[1:-1]):
                return first
        if first == "case" and colon in tokens:
            for i in [i for i, k in enumerate(tokens) if k == colon]:
                if g["case"].recognise(tokens[1:i]) and g["simple"].recognise(tokens[i + 1 :]):
                    return "case+"
        return "LINE" if g["simple"].recognise(tokens) else ""

    def accepts(self, text: str) -> bool:
        if "\0" in text:
            return False
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        known, kind = self.known, self._kind
        opens, closes = {known["("]: known[")"], known["["]: known["]"], known["{"]: known["}"]}, {known[")"], known["]"], known["}"]}
        shape: list[str] = []
        indents = [(0, 0)]
        line: list[int] = []
        first = second = ""
        stack: list[int] = []
        blanks = ""
        # A leading newline token carries the indentation of the first line.
        for t in [*self.pattern.findall("\n" + text), "\n"]:
            k = known.get(t)
            if k is None:
                k = kind(t)
                if k is None:
                    if t[0] == "\n" and not stack:
                        if line:
                            got = self._line(line, first, second)
                            if not got:
                                return False
                            shape.append(got)
                            line, first, second = [], "", ""
                        blanks = t[1:]
                    continue
                if k < 0:
                    return False
            if not line:
                first = t
                width = self._width(blanks)
                if width != indents[-1]:
                    if width[0] > indents[-1][0] and width[1] > indents[-1][1]:
                        indents.append(width)
                        shape.append("INDENT")
                    else:
                        while indents[-1][0] > width[0]:
                            indents.pop()
                            shape.append("DEDENT")
                        if indents[-1] != width:
                            return False
            elif len(line) == 1:
                second = t
            line.append(k)
            if k in opens:
                stack.append(opens[k])
            elif k in closes and (not stack or stack.pop() != k):
                return False
        if stack or line:
            return False
        shape += ["DEDENT"] * (len(indents) - 1)
        return self._blocks(tuple(shape))

    @staticmethod
    def _width(blanks: str) -> tuple[int, int]:
        if "\t" not in blanks and "\f" not in blanks:
            return len(blanks), len(blanks)
        wide = narrow = 0
        for c in blanks:
            if c == " ":
                wide, narrow = wide + 1, narrow + 1
            elif c == "\t":
                wide, narrow = (wide // 8 + 1) * 8, narrow + 1
            else:
                wide = narrow = 0
        return wide, narrow

    def _blocks(self, shape: tuple[str, ...]) -> bool:
        # A run of plain lines parses like one.
        short = [s for i, s in enumerate(shape) if s != "LINE" or not i or shape[i - 1] != "LINE"]
        key = tuple(short)
        got = self.files.get(key)
        if got is None:
            if len(self.files) >= MAX_SHAPES:
                self.files.clear()
            t = self.file.terminals
            tokens: list[int] = []
            for s in short:
                tokens += [t[s[:-1]], t["BODY"]] if s[-1] == "+" else [t[s]]
            got = self.files[key] = self.file.recognise(tokens)
        return got


def python_parses(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False
        return True


_MAKERS = {"python": _Python, "java": _Java, "cpp": _Cpp, "c": lambda: _Cpp("c"), "go": _Go, "javascript": _JavaScript}
_READY: dict[str, object] = {}


def parses(language: str, text: str) -> bool:
    """Whether some dialect of the language accepts the file."""
    if language not in _READY:
        _READY[language] = _MAKERS[language]()
    if _READY[language].accepts(text):
        return True
    return language == "python" and python_parses(text)


def language_of(tag: Column) -> Column:
    """Supported language that a tag names; other tags are themselves, in lower case without blanks."""
    plain = F.regexp_replace(F.lower(tag), r"\s+", "")
    out = plain
    for language, names in LANGUAGES.items():
        out = F.when(plain.isin(*names), F.lit(language)).otherwise(out)
    return out


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [parses(a, b) if a in _MAKERS else None for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ok, pa.bool_())], names=["tbl", "rec_id", "repo", "language", "parses"])


def checked(files: DataFrame) -> DataFrame:
    """``tbl, rec_id, repo, language, parses`` of every file that counts; ``parses`` is null where the language is not supported.

    ``files``: ``tbl, rec_id, repo, tag, file``.
    """
    src = files.select("tbl", F.col("rec_id").cast("bigint").alias("rec_id"), "repo", language_of(F.col("tag")).alias("language"), "file")
    src = src.select("tbl", "rec_id", "repo", "language", F.when(F.col("language").isin(*LANGUAGES), F.col("file")).otherwise(F.lit("-")).alias("body"), "file")
    src = spread(src.where("language <> '' and file <> ''").drop("file"))
    return src.mapInArrow(_check, "tbl string, rec_id bigint, repo string, language string, parses boolean")


def rates(files: DataFrame) -> DataFrame:
    """``repo, language, n_files, n_checked, n_invalid, invalid_rate`` per repository and language (null repositories together); the rate is null where no file is checked."""
    n, bad = F.count("parses"), F.count_if(~F.col("parses"))
    return checked(files).groupBy("repo", "language").agg(F.count("*").alias("n_files"), n.alias("n_checked"), bad.alias("n_invalid"), F.round(bad / F.nullif(n, F.lit(0)), 6).alias("invalid_rate"))
