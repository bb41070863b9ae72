"""A generalised LL recogniser with a graph-structured stack, and token shapes of source files.

A file is first reduced to a string with one character for each token. Bracketed groups are replaced
from the inside out by one character that stands for the roles the group can play (a block, an
object, arguments, ...): groups that can play the same roles are the same character, so the strings
between brackets recur all over a corpus and each is recognised once in a worker. What a group may be
in its place is decided by the grammar around it, which is ambiguous and needs generalised parsing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from codeloom.functions.lexing import END, ERROR, SUB

#: Strings and their results that are kept by a worker; the tables start anew when full.
KEPT = 300_000

#: Nesting of brackets that Language.accepts looks into unless the caller asks for all, as parsing.fault does.
DEEPEST = 200

_SYMBOL = re.compile(r"\s*('[^']+'|<\w+>|\w+|[()|?*+=])")


class Grammar:
    """Rules "Name = ...": 'text' is a token, UPPER a class of tokens, <Role> a bracketed group; ? * + and ( | ) as usual."""

    def __init__(self, rules: str, classes: dict[str, set[str]], chars: dict[str, str]):
        self.terminals: dict[str, int] = {}
        self.rules: dict[str, list[list[int | str]]] = {}
        self.chars = chars
        for line in re.sub(r"\n[ \t]+", " ", rules.strip()).split("\n"):
            if line.strip():
                name, _, body = line.partition("=")
                symbols = _SYMBOL.findall(body)
                left = self._alternatives(name.strip(), symbols, classes)
                assert not left, (name, left)
        self.masks: dict[str, int] = {}
        for t, bit in self.terminals.items():
            for token in classes.get(t, {t[1:-1]} if t[0] == "'" else ()):
                self.masks[chars[token]] = self.masks.get(chars[token], 0) | 1 << bit
        missing = {s for alts in self.rules.values() for a in alts for s in a if isinstance(s, str)} - set(self.rules)
        assert not missing, missing
        self._prepare()
        self.known: dict[tuple[tuple[str, ...], str], frozenset[str]] = {}

    def _terminal(self, t: str) -> int:
        return self.terminals.setdefault(t, len(self.terminals))

    def _alternatives(self, name: str, symbols: list[str], classes: dict[str, set[str]]) -> list[str]:
        """Reads alternatives up to a closing bracket or the end; returns what is left."""
        alts: list[list[int | str]] = [[]]
        self.rules[name] = alts
        while symbols:
            s = symbols.pop(0)
            if s == ")":
                return symbols
            if s == "|":
                alts.append([])
                continue
            unit: int | str
            if s == "(":
                unit = f"{name}~{len(self.rules)}"
                symbols = self._alternatives(unit, symbols, classes)
            elif s[0] in "'<" or s in classes:
                unit = self._terminal(s)
            else:
                unit = s
            if symbols and symbols[0] in "?*+":
                op, again = symbols.pop(0), f"{name}~{len(self.rules)}"
                # recursion on the left: a list has one node of the stack, whatever its length
                self.rules[again] = [[unit], []] if op == "?" else [[again, unit], []]
                if op == "+":
                    alts[-1].append(unit)
                unit = again
            alts[-1].append(unit)
        return []

    def _prepare(self) -> None:
        nullable: set[str] = set()
        first: dict[str, int] = dict.fromkeys(self.rules, 0)
        while True:
            before = (len(nullable), sum(m.bit_count() for m in first.values()))
            for name, alts in self.rules.items():
                for alt in alts:
                    for s in alt:
                        first[name] |= 1 << s if isinstance(s, int) else first[s]
                        if isinstance(s, int) or s not in nullable:
                            break
                    else:
                        nullable.add(name)
            if before == (len(nullable), sum(m.bit_count() for m in first.values())):
                break
        self.entries: dict[str, list[tuple[tuple[int | str, ...], int, bool]]] = {}
        for name, alts in self.rules.items():
            self.entries[name] = []
            for alt in alts:
                mask, empty = 0, True
                for s in alt:
                    mask |= 1 << s if isinstance(s, int) else first[s]
                    if isinstance(s, int) or s not in nullable:
                        empty = False
                        break
                self.entries[name].append((tuple(alt), mask, empty))

    def accepts(self, start: str, text: str) -> bool:
        return bool(self.together((start,), text))

    def together(self, starts: tuple[str, ...], text: str) -> frozenset[str]:
        """Which of some rules derive the text. They are run together on one stack, so that what they share is read once."""
        known = self.known.get((starts, text))
        if known is None:
            if len(self.known) > KEPT:
                self.known.clear()
            known = self.known[starts, text] = self._recognise(starts, text)
        return known

    def _recognise(self, starts: tuple[str, ...], text: str) -> frozenset[str]:
        masks, entries, n = [self.masks.get(c, 0) for c in text], self.entries, len(text)
        if not all(masks):
            return frozenset()
        masks.append(0)
        # a node of the stack stands for a call of a rule at a position; its edges lead to where the callers go on
        edges: dict[tuple[str, int], set[tuple]] = {(s, 0): set() for s in starts}
        ends: dict[tuple[str, int], set[int]] = {(s, 0): set() for s in starts}
        missing = set(edges)
        todo: list[tuple[tuple[int | str, ...], int, tuple[str, int], int]] = []
        for s in starts:
            for alt, mask, empty in entries[s]:
                if empty or mask & masks[0]:
                    todo.append((alt, 0, (s, 0), 0))
        while todo:
            alt, dot, node, at = todo.pop()
            size = len(alt)
            while dot < size:
                s = alt[dot]
                if isinstance(s, int):
                    if masks[at] >> s & 1:
                        dot, at = dot + 1, at + 1
                        continue
                    break
                callee, back = (s, at), (alt, dot + 1, node)
                known = edges.get(callee)
                if known is None:
                    edges[callee], ends[callee] = {back}, set()
                    for a, mask, empty in entries[s]:
                        if empty or mask & masks[at]:
                            todo.append((a, 0, callee, at))
                elif back not in known:
                    known.add(back)
                    for end in ends[callee]:
                        todo.append((alt, dot + 1, node, end))
                break
            else:
                if at not in ends[node]:
                    if at == n and node in missing:
                        missing.remove(node)
                        if not missing:
                            break
                    ends[node].add(at)
                    for a, d, p in edges[node]:
                        todo.append((a, d, p, at))
        return frozenset(s for s in starts if (s, 0) not in missing)


class Kinds(dict):
    """Characters of tokens; those of words are worked out once."""

    def __init__(self, fixed: dict[str, str], other: Callable[[str], str]):
        super().__init__(fixed)
        self.fixed, self.other = fixed, other

    def __missing__(self, token: str) -> str:
        if len(self) > KEPT:
            self.clear()
            self.update(self.fixed)
        kind = self[token] = self.other(token)
        return kind


#: Where the characters of groups begin, by opening bracket, and for how many sets of roles each has room.
GROUPS = {"{": 0xF0000, "(": 0xF4000, "[": 0xF8000, SUB: 0xFC000}
ROOM = 0x3FFF
INNERMOST = re.compile("|".join(f"\\{a}[^()\\[\\]{{}}{SUB}{END}]*\\{z}" for a, z in ("()", "[]", "{}", (SUB, END))))
_BRACKETS = re.compile(f"[()\\[\\]{{}}{SUB}{END}]")


def outside_angles(text: str, separator: str) -> list[str]:
    """The parts between separators, those within type arguments aside."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        elif c == separator and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


class Dialect:
    """A grammar with what its bracketed groups can be.

    roles: by bracket, the name of each role with a way to tell whether the text of a group plays it:
    (rule,) the whole text; (rule, separator) each part between separators, where
    empty parts count as absent.
    """

    def __init__(self, name: str, grammar: Grammar, roles: dict[str, dict[str, tuple]], clean: Callable[[str], str] = lambda s: s):
        self.name, self.grammar, self.roles, self.clean = name, grammar, roles, clean
        self.groups: dict[str, str] = {}
        self.played: dict[str, dict[frozenset[str], str]] = {bracket: {} for bracket in roles}
        assert all(2 ** len(r) <= ROOM for r in roles.values())

    def plays(self, how: tuple, text: str) -> bool:
        accepts = self.grammar.accepts
        if callable(how[0]):
            return how[0](self, text)
        if len(how) == 1:
            return accepts(how[0], text)
        if not text:
            return True
        parts = text.split(how[1])
        if parts[-1] == "" and len(parts) > 1:
            parts.pop()  # a separator at the end
        if all(accepts(how[0], p) for p in parts):
            return True
        return "<" in text and all(accepts(how[0], p) for p in outside_angles(text.removesuffix(how[1]), how[1]))

    def _group(self, m: re.Match[str]) -> str:
        whole = m.group()
        char = self.groups.get(whole)
        if char is None:
            if len(self.groups) > KEPT:
                self.groups.clear()
            text = self.clean(whole[1:-1])
            can = frozenset(r for r, how in self.roles[whole[0]].items() if self.plays(how, text))
            played = self.played[whole[0]]
            char = played.get(can)
            if char is None:
                char = played[can] = chr(GROUPS[whole[0]] + len(played)) if can else ERROR
                if can:
                    for r in can:
                        if (bit := self.grammar.terminals.get(f"<{r}>")) is not None:
                            self.grammar.masks[char] = self.grammar.masks.get(char, 0) | 1 << bit
            self.groups[whole] = char
        return char

    def reduce(self, shape: str, deepest: int | None = None) -> str | None:
        """The shape without brackets, or None if they don't match or a group can be nothing."""
        turns = 0
        while deepest is None or turns < deepest:  # each turn that finds a group makes the shape shorter
            turns += 1
            shape, n = INNERMOST.subn(self._group, shape)
            if ERROR in shape:
                return None
            if not n:
                return None if _BRACKETS.search(shape) else shape
        return None
