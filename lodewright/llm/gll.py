"""A generalised LL recogniser with a graph-structured stack, over compact grammars.

Grammars are written as text, one rule a line: ``name : body`` with ``|``, ``( )``, ``[ ]`` (optional),
``{ }`` (repeated), quoted terminals and bare names (rules, or terminals if no rule has that name).
Bodies become chains of slots; a repetition is a rule of its own.

Recognition follows descriptors (slot, stack node, position). Stack nodes are shared per (rule, position)
with edges to all callers, so alternatives that call the same rule at one place are parsed once, and
left-over ambiguity costs no more than the grammar's cubic bound. First and follow sets prune
alternatives; a rule whose alternatives all but one are pruned runs on without a new descriptor.

Rules whose extent the brackets fix are *islands*: a rule in braces ends at the matching brace, a rule
of statements without their end mark runs up to the next mark of the same depth. An island is
recognised once by itself, its verdict is memoised by its tokens, and whoever calls it there steps over it,
so the work is that of the different statements and blocks, not of the files. All grammars are
balanced in brackets, so a text whose brackets do not match is rejected at once.

Several dialects of a language are start rules of one grammar: they run together on one descriptor set
and share every stack node, and a text is accepted if any of them is.
"""

from __future__ import annotations

import gc
import re
from array import array

_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|(\w+)|([|()\[\]{}]))")
END = "$"
BRACKETS = {"(": ")", "[": "]", "{": "}"}
MAX_ISLANDS, LONG = 200_000, 2_000  # verdicts kept, and tokens of the longest island that is kept


class Grammar:
    """A compiled grammar. ``terminals`` maps terminals to numbers; ``$`` is the end of the text.

    ``braces`` and ``runs`` name the islands of the two kinds, ``marks`` the terminals that end a run.
    ``never`` names terminals a rule must not begin with. The terminal ``&}`` takes no token: it holds
    before a closing brace or the end.
    """

    def __init__(self, text: str, starts: tuple[str, ...], braces: tuple[str, ...] = (), runs: tuple[str, ...] = (), marks: tuple[str, ...] = (";",), never: dict[str, tuple[str, ...]] | None = None) -> None:
        self.islands = dict.fromkeys(braces, 1) | dict.fromkeys(runs, 2)
        self.marks, self.never = marks, never or {}
        self.memo: dict[tuple[int, bytes], bool] = {}
        self.rules: dict[str, list[list[str]]] = {}
        bodies: dict[str, str] = {}
        name = ""
        for line in text.strip().splitlines():
            head = re.match(r"(\w+)\s*:(?!:)(.*)", line)
            if head:
                name = head[1]
                bodies[name] = head[2]
            elif line.strip():
                bodies[name] += " " + line
        self._names = set(bodies)
        self._new = 0
        for name, body in bodies.items():
            tokens = [m.groups() for m in _TOKEN.finditer(body.rstrip())]
            alts, rest = self._alternatives(tokens, 0)
            if rest != len(tokens):
                raise ValueError(f"grammar rule {name}: cannot read {tokens[rest:]}")
            self.rules[name] = alts
        self.rules["_start"] = [[s, END] for s in starts]
        self._compile()

    def _fresh(self, alts: list[list[str]]) -> str:
        self._new += 1
        name = f"_{self._new}"
        self.rules[name] = alts
        self._names.add(name)
        return name

    def _alternatives(self, t: list, i: int) -> tuple[list[list[str]], int]:
        alts: list[list[str]] = [[]]
        while i < len(t):
            lit, name, op = t[i]
            if lit is not None:
                alts[-1].append("'" + re.sub(r"\\(.)", r"\1", lit))
                i += 1
            elif name is not None:
                alts[-1].append(name if name in self._names else "'" + name)
                i += 1
            elif op == "|":
                alts.append([])
                i += 1
            elif op in "([{":
                inner, i = self._alternatives(t, i + 1)
                i += 1
                if op == "{":
                    rep = self._fresh([])
                    self.rules[rep] = [[*a, rep] for a in inner] + [[]]
                    alts[-1].append(rep)
                else:
                    alts[-1].append(self._fresh(inner + ([[]] if op == "[" else [])))
            else:
                break
        return alts, i

    def _compile(self) -> None:
        rules = self.rules
        terms = sorted({x for alts in rules.values() for a in alts for x in a if x[0] == "'"} - {"'&}"})
        self.terminals = {x[1:]: k + 1 for k, x in enumerate(terms)} | {END: 0}
        num = {x: self.terminals[x[1:]] for x in terms} | {END: 0}
        num["'&}"] = self.before = len(self.terminals)
        closing = {0, num.get("'}", 0)}
        first: dict[str, set[int]] = {n: set() for n in rules}
        empty: set[str] = set()
        moved = True
        while moved:
            moved = False
            for n, alts in rules.items():
                for a in alts:
                    f, e = self._first(a, first, empty, num)
                    if not f <= first[n]:
                        first[n] |= f
                        moved = True
                    if e and n not in empty:
                        empty.add(n)
                        moved = True
        for f in first.values():
            if self.before in f:
                f |= closing
        follow: dict[str, set[int]] = {n: {0} if n in self.islands else set() for n in rules}
        moved = True
        while moved:
            moved = False
            for n, alts in rules.items():
                for a in alts:
                    for k, x in enumerate(a):
                        if x in rules:
                            f, e = self._first(a[k + 1 :], first, empty, num)
                            f = f | follow[n] if e else f
                            if not f <= follow[x]:
                                follow[x] |= f
                                moved = True
        # A slot is (symbol, next slot): terminals as numbers >= 0, rules as -1 - number; None ends a rule.
        index = {n: k for k, n in enumerate(rules)}
        self.slots: list[tuple[int, int] | None] = []
        self.choose: list[dict[int, tuple[int, ...]]] = []
        for n, alts in rules.items():
            table: dict[int, list[int]] = {}
            for a in alts:
                begin = len(self.slots)
                for k, x in enumerate(a):
                    self.slots.append((-1 - index[x] if x in rules else num[x], len(self.slots) + 1))
                self.slots.append(None)
                f, e = self._first(a, first, empty, num)
                for t in f | follow[n] if e else f:
                    table.setdefault(t, []).append(begin)
            for t in self.never.get(n, ()):
                table.pop(num["'" + t], None)
            if self.before in table:
                for t in closing:
                    table.setdefault(t, []).extend(table[self.before])
            self.choose.append({t: tuple(dict.fromkeys(b)) for t, b in table.items()})
        self.start = index["_start"]
        self.kinds = [self.islands.get(n, 0) for n in rules]
        self.closing = closing
        self._open = {num["'" + a]: num["'" + b] for a, b in BRACKETS.items() if "'" + a in num and "'" + b in num}
        self._close = set(self._open.values())
        self._marks = {num["'" + t] for t in self.marks if "'" + t in num}

    @staticmethod
    def _first(a: list[str], first: dict, empty: set, num: dict) -> tuple[set[int], bool]:
        out: set[int] = set()
        for x in a:
            if x in first:
                out |= first[x]
                if x not in empty:
                    return out, False
            else:
                out.add(num[x])
                return out, False
        return out, True

    def recognise(self, tokens: list[int]) -> bool:
        """Whether the token numbers (without the end) are a text of any start rule.

        A terminal the grammar does not know is any negative number.
        """
        collects = gc.isenabled()
        gc.disable()  # millions of small tuples, none of them in a cycle
        try:
            return self._recognise(tokens)
        finally:
            if collects:
                gc.enable()

    def _recognise(self, tokens: list[int]) -> bool:
        if not self.islands:
            return self._run(tokens, 0, self.start)
        if min(tokens, default=0) < 0 or not self._extents(tokens):
            return False
        if len(self.memo) >= MAX_ISLANDS:
            self.memo.clear()
        self._raw = array("H", tokens).tobytes()
        try:
            return self._run(tokens, 0, self.start)
        except RecursionError:  # blocks nested hundreds deep: the recogniser itself needs no depth
            kinds, self.kinds = self.kinds, [0] * len(self.kinds)
            try:
                return self._run(tokens, 0, self.start)
            finally:
                self.kinds = kinds

    def _extents(self, tokens: list[int]) -> bool:
        """Where the island that begins at each token would end; whether the brackets match."""
        opens, closes, marks = self._open, self._close, self._marks
        n = len(tokens)
        self._shut = shut = [0] * n  # the matching bracket
        self._stop = stop = [0] * n  # next mark or closing bracket of the same depth, at or behind the token
        stack, now = [], n
        for i in range(n - 1, -1, -1):
            t = tokens[i]
            if t in closes:
                stack.append((t, i, now))
                stop[i] = i
                now = i
            elif t in opens:
                if not stack or stack[-1][0] != opens[t]:
                    return False
                _, shut[i], now = stack.pop()
                stop[i] = now
            else:
                if t in marks:
                    now = i
                stop[i] = now
        return not stack

    def _island(self, rule: int, text: list[int], at: int, first: int) -> int:
        """Place behind the island of ``rule`` at ``at`` of ``text``, which begins at token ``first``; -1 if there is none."""
        begin = first + at
        if self.kinds[rule] == 1:
            end = self._shut[begin] + 1
            if end == 1:
                return -1
        else:
            end = self._stop[begin]
        key = (rule, self._raw[2 * begin : 2 * end])
        got = self.memo.get(key)
        if got is None:
            got = self._run(text[at : end - first], begin, rule)
            if end - begin <= LONG:
                self.memo[key] = got
        return end - first if got else -1

    def _run(self, tokens: list[int], first: int, start: int) -> bool:
        """Whether ``tokens``, which begin at token ``first`` of the whole text, are a text of the rule ``start``."""
        slots, choose, kinds, before, closing = self.slots, self.choose, self.kinds, self.before, self.closing
        text = [*tokens, 0]
        size = len(text)
        goal = size if start == self.start else size - 1
        # Stack node (rule, position) -> callers [(return slot, caller's node)] and ends found so far.
        callers: dict[int, list[tuple[int, int]]] = {}
        ends: dict[int, list[int]] = {}
        seen: set[tuple[int, int, int]] = set()
        todo: list[tuple[int, int, int]] = []
        root = start * size
        callers[root] = []
        ends[root] = []
        for b in choose[start].get(text[0], ()):
            todo.append((b, root, 0))
        while todo:
            slot, node, at = todo.pop()
            while True:
                s = slots[slot]
                if s is None:
                    if at == goal and node == root:
                        return True
                    found = ends[node]
                    if at in found:
                        break
                    found.append(at)
                    back = callers[node]
                    if not back:
                        break
                    for c in back[1:]:
                        d = (*c, at)
                        if d not in seen:
                            seen.add(d)
                            todo.append(d)
                    slot, node = back[0]
                    d = (slot, node, at)
                    if d in seen:
                        break
                    seen.add(d)
                    continue
                symbol, after = s
                if symbol >= 0:
                    if at >= size:
                        break
                    if text[at] != symbol:
                        if symbol != before or text[at] not in closing:
                            break
                    else:
                        at += 1
                    slot = after
                    continue
                rule = -1 - symbol
                ways = choose[rule].get(text[at]) if at < size else None
                if ways is None:
                    break
                if kinds[rule] and (at or rule != start):
                    at = self._island(rule, text, at, first)
                    if at < 0:
                        break
                    slot = after
                    continue
                below = rule * size + at
                back = callers.get(below)
                if back is not None:
                    c = (after, node)
                    if c not in back:
                        back.append(c)
                        for e in ends[below]:
                            d = (after, node, e)
                            if d not in seen:
                                seen.add(d)
                                todo.append(d)
                    break
                callers[below] = [(after, node)]
                ends[below] = []
                for w in ways[1:]:
                    todo.append((w, below, at))
                slot, node = ways[0], below
        return False
