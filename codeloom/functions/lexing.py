"""State machines that read source files into tokens, and tell strings and comments apart from code.

JavaScript and TypeScript need a stack: a template may hold expressions that hold templates, to any
depth, and whether a slash divides or begins a regular expression depends on the token before it and,
behind a closing bracket, on what that bracket closes. Python needs one for the fields of formatted
strings, which hold expressions again. Go, Java and JSON have nothing that nests within a token.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: A character that can be part of no file that parses.
ERROR = "\0"
#: Brackets around what stands between the braces of a template or of a formatted string.
SUB, END = "⟦", "⟧"
#: Tokens that stand for any template, regular expression and formatted string.
TEMPLATE, REGEX, FORMATTED = "``", "/r/", 'f""'


class Lexed(NamedTuple):
    tokens: list[str]
    comments: list[tuple[int, int]]
    literals: list[tuple[int, int]]  # of a template its pieces


NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
_COMMENT = r"//[^\n]*+|/\*(?:[\s\S]*?\*/|[\s\S]*)"
_QUOTED = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"

# --------------------------------------------------------------------------- JavaScript and TypeScript

_SCRIPT = re.compile(
    rf"(?:[^\W\d]|\$)[\w$]*+|{_COMMENT}|{_QUOTED}|{NUMBER}n?(?![\w$])"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*"
    r"|\n|\S"
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[\w$]*+")
_QUASI = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_SPECIAL = frozenset("/`(){}'\"")
# Words that an expression follows, and those whose brackets a statement follows.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "extends", "default"}
_HEADS = {"if", "while", "for", "with"}
_BEFORE_OBJECT = {"(", ",", "=", "[", "?", "return", "typeof", "in", "of", "delete", "void", "throw", "new", "instanceof", "yield", "await", "case", "default", "extends", "...", SUB}


def script(content: str) -> Lexed:
    """An unterminated string, template, comment or regular expression gives the token ERROR."""
    tokens: list[str] = []
    comments: list[tuple[int, int]] = []
    literals: list[tuple[int, int]] = []
    stack: list[str | bool] = []  # for each open bracket whether a statement follows it, or TEMPLATE
    before, statement, at = "", True, 0  # statement: whether one follows the bracket that was closed last
    add = tokens.append

    def quasi(start: int, at: int) -> int:
        """Reads the text of a template on to its end or the next field."""
        nonlocal before
        at = _QUASI.match(content, at).end()  # type: ignore[union-attr]
        if content.startswith("`", at):
            before = TEMPLATE
            literals.append((start, at + 1))
            return at + 1
        if content.startswith("${", at):
            stack.append(TEMPLATE)
            before = SUB
            add(SUB)
            literals.append((start, at + 2))
            return at + 2
        add(ERROR)
        literals.append((start, at))
        return at

    go_on = True
    while go_on:
        go_on = False
        for m in _SCRIPT.finditer(content, at):
            t = m.group()
            c = t[0]
            if c not in _SPECIAL:
                add(t)
                if t != "\n":
                    if before == "." and t.isidentifier():
                        before = "name"
                    elif not (t == "await" and before == "for"):
                        before = t
                continue
            if c == "/":
                if t[1:2] in ("/", "*"):
                    comments.append(m.span())
                    if t[1] == "*" and (len(t) < 4 or not t.endswith("*/")):
                        add(ERROR)
                    elif "\n" in t:
                        add("\n")
                    continue
                if before in (")", "}"):
                    expression = statement
                elif before[:1].isalpha() or before[:1] in ("_", "$"):
                    expression = before in _BEFORE_EXPRESSION
                else:
                    expression = before not in ("]", "++", "--", TEMPLATE, REGEX, '""') and not before[:1].isdigit() and not (before[:1] == "." and len(before) > 1 and before[1].isdigit())
                if expression:
                    r = _REGEX.match(content, m.start())
                    if r is None:
                        add(ERROR)
                        continue
                    add(REGEX)
                    literals.append(r.span())
                    before, at, go_on = REGEX, r.end(), True
                    break
                add(t)
                before = t
            elif c == "`":
                add(TEMPLATE)
                at, go_on = quasi(m.start(), m.end()), True
                break
            elif c in "'\"":
                if len(t) > 1:
                    literals.append(m.span())
                    before = '""'
                    add(before)
                else:
                    add(ERROR)
            elif c == "(":
                stack.append(before in _HEADS)
                add(c)
                before = c
            elif c == "{":
                inner = stack[-1] if stack else True
                stack.append(before not in _BEFORE_OBJECT and not (before == ":" and inner is False) and not (len(before) > 1 and before[-1] == "=" and before[0] not in "=!<>") and before not in ("&&", "||", "??", "+", "!"))
                add(c)
                before = c
            elif c == "}" and stack and stack[-1] is TEMPLATE:
                stack.pop()
                add(END)
                at, go_on = quasi(m.start(), m.end()), True
                break
            else:
                statement = bool(stack.pop()) if stack else True
                add(c)
                before = c
    return Lexed(tokens, comments, literals)


# --------------------------------------------------------------------------- Go, Java and JSON

_GO = re.compile(
    rf"[^\W\d]\w*+|{_COMMENT}|`[^`]*+`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{{2}}|u[\da-fA-F]{{4}}|U[\da-fA-F]{{8}}|[0-7]{{3}}|.))'"
    rf"|{NUMBER}i?(?![\w])|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||&\^|==|!=|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\n|\S"
)
_JAVA = re.compile(
    rf"(?:[^\W\d]|\$)[\w$]*+|{_COMMENT}|\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{{4}}|[0-7]{{1,3}}|.))'"
    r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$])"
    r"|\.\.\.|<<=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\S"
)
_JSON = re.compile(r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4}))*+\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[^ \t\r\n]")
go_tokens, java_tokens, json_tokens = _GO.findall, _JAVA.findall, _JSON.findall


def _flat(token: re.Pattern[str], content: str) -> Lexed:
    comments, literals = [], []
    for m in token.finditer(content):
        t = m.group()
        if t[0] in "/\"'`" and len(t) > 1:
            if t[:2] in ("//", "/*"):
                comments.append(m.span())
            elif t[0] != "/":
                literals.append(m.span())
    return Lexed([], comments, literals)


# What can hold a declaration's words or brackets: the rest of the tokens need not be told apart for that.
_GO_SPANS = re.compile(rf"{_COMMENT}|`[^`]*+`?|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)++'?")
_JAVA_SPANS = re.compile(rf"{_COMMENT}|\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)++'?")


def go(content: str) -> Lexed:
    return _flat(_GO_SPANS, content)


def java(content: str) -> Lexed:
    return _flat(_JAVA_SPANS, content)


# --------------------------------------------------------------------------- Python

_PLAIN = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_PYTHON = re.compile(
    r"(?P<f>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|\"|'))"
    rf"|{_PLAIN}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*+\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+')"
    r"|[^\W\d]\w*+|#[^\n]*+|\\\r?\n|\r?\n[ \t\f]*+"
    r"|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|[eE][+-]?\d(?:_?\d)*)[jJ]?|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[jJ]|(?:[1-9](?:_?\d)*|0(?:_?0)*))(?!(?!(?:and|else|for|if|in|is|not|or)\b)\w)"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[^ \t\f\r]"
)
_HAS_FORMATTED = re.compile(r"[fF][rR]?[\"']|[rR][fF][\"']")
_CONVERSION = re.compile(r"[ \t]*[sra][ \t]*(?=[:}])")
_TEXT = {
    (q, raw): re.compile(rf"(?:[^\\{{}}{q[0]}{'' if len(q) > 1 else chr(92) + 'n'}]|{{{{|}}}}|" + ("" if raw else r"\\N\{[^{}\n]*\}|") + r"\\(?:[^{}]|(?=[{}]))" + (rf"|{q[0]}(?!{q[0]}{q[0]})" if len(q) > 1 else "") + ")*+")
    for q in ('"', "'", '"""', "'''")
    for raw in (False, True)
}
_SPEC = {q: re.compile(rf"(?:[^{{}}{q[0]}{'' if len(q) > 1 else chr(92) + 'n'}]" + (rf"|{q[0]}(?!{q[0]}{q[0]})" if len(q) > 1 else "") + ")*+") for q in ('"', "'", '"""', "'''")}


class _Field:
    """A field of a formatted string: the string's quotes, open brackets, and whether it stands in another field's format."""

    __slots__ = ("depth", "nested", "quote", "raw", "start")

    def __init__(self, quote: str, raw: bool, start: int, nested: bool):
        self.quote, self.raw, self.start, self.nested, self.depth = quote, raw, start, nested, 0


def python_tokens(content: str) -> list[str]:
    return python(content).tokens if _HAS_FORMATTED.search(content) else [m.group() for m in _PYTHON.finditer(content)]


def python(content: str) -> Lexed:
    """A formatted string is FORMATTED and each of its fields a group in SUB and END; what has no end gives ERROR."""
    tokens: list[str] = []
    comments: list[tuple[int, int]] = []
    literals: list[tuple[int, int]] = []
    stack: list[_Field] = []
    add = tokens.append

    def text(quote: str, raw: bool, start: int, at: int) -> int:
        at = _TEXT[quote, raw].match(content, at).end()  # type: ignore[union-attr]
        if content.startswith("{", at):
            stack.append(_Field(quote, raw, start, False))
            add(SUB)
            return at + 1
        if content.startswith(quote, at):
            if not stack:
                literals.append((start, at + len(quote)))
            return at + len(quote)
        add(ERROR)
        return max(at + 1, start + 1)

    def spec(at: int) -> int:
        f = stack[-1]
        at = _SPEC[f.quote].match(content, at).end()  # type: ignore[union-attr]
        if content.startswith("{", at):
            stack.append(_Field(f.quote, f.raw, f.start, True))
            add(SUB)
            return at + 1
        if content.startswith("}", at):
            return close(at + 1)
        add(ERROR)
        return at + 1

    def close(at: int) -> int:
        f = stack.pop()
        add(END)
        return spec(at) if f.nested else text(f.quote, f.raw, f.start, at)

    at, go_on = 0, True
    while go_on:
        go_on = False
        for m in _PYTHON.finditer(content, at):
            t = m.group()
            if m.lastgroup:
                quote = t.lstrip("fFrR")
                add(FORMATTED)
                at, go_on = text(quote, len(t) - len(quote) > 1, m.start(), m.end()), True
                break
            if stack and t[0] in "([{)]}:!":
                f = stack[-1]
                if f.depth == 0 and t == "}":
                    at, go_on = close(m.end()), True
                    break
                if f.depth == 0 and t[0] == ":":
                    at, go_on = spec(m.start() + 1), True
                    break
                if f.depth == 0 and t == "!":
                    k = _CONVERSION.match(content, m.end())
                    if k is None:
                        add(ERROR)
                        continue
                    at, go_on = k.end(), True
                    break
                f.depth += (t[0] in "([{") - (t[0] in ")]}")
            elif t[0] == "#":
                comments.append(m.span())
                continue
            elif t[-1] in "\"'" and not stack and len(t) > 1:
                literals.append(m.span())
            add(t)
    if stack:
        add(ERROR)
    return Lexed(tokens, comments, literals)


LEXERS = {"python": python, "javascript": script, "typescript": script, "go": go, "java": java}


def blanked(content: str, lexed: Lexed) -> str:
    """The content with comments made blank and literals reduced to their quotes; every offset and line end stays."""
    parts, at = [], 0
    for start, end, comment in sorted([(*c, True) for c in lexed.comments] + [(*x, False) for x in lexed.literals]):
        token = content[start:end]
        parts.append(content[at:start])
        parts.append(_NOT_LINE_END.sub(" ", token) if comment else '"' + _NOT_LINE_END.sub(" ", token[1:-1]) + '"' * (len(token) > 1))
        at = end
    return "".join(parts) + content[at:]


_NOT_LINE_END = re.compile(r"[^\n]")
